"""Per-run options of the article builder (the reference's keyword flags)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Options:
    # depth > 1 adds a company-name query per (ticker, source)
    depth: int = 1
    # take links of any site: neither the source check of result links nor
    # the host check of the URL validity test applies
    curious: bool = False
    # drop candidates whose URL fails the validity test
    validate_url: bool = False
    # drop articles without a publish date
    date_checker: bool = False
    # drop articles shorter than min_length words
    length_check: bool = False
    min_length: int = 30
    # node attributes beside title, date, source, ticker and URL
    industry: bool = True
    sector: bool = True
    # the class of the price move after publication; needs labelled nodes
    classification: bool = False
