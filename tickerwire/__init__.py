"""tickerwire: a Spark-native engine for company news corpora.

Every public function takes and returns DataFrames or Columns, performs no
action and never brings rows to the driver; Catalyst plans the work.
"""

from tickerwire.options import Options
from tickerwire.session import checkpoint_dir, get_session, table

__all__ = ["Options", "get_session", "checkpoint_dir", "table"]
