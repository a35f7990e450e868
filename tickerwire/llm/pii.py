"""Personal data: fixed patterns, then information-theoretic sanitisation.

The patterns find e-mail addresses, IP addresses, payment cards and phone
numbers; every distinct value found is a protected entity. Masking the value
alone may not hide it: a term that occurs almost only beside it still reveals
it. Corpus co-occurrence, counted over distinct texts, tells how much: with N
texts, n(e) with the entity, n(t) with the term and n(e,t) with both,

    PMI(e; t) = log2(N n(e,t) / (n(e) n(t)))     what the term tells of it
    IC(e)     = log2(N / n(e))                   all there is to tell

A term's disclosure is PMI / IC, at most 1. In a text that holds the entity, a
term that discloses at least ``remove_at`` of it is removed; one that discloses
at least ``generalise_at`` is replaced by a term of less information that the
entity's texts share: of those that do not disclose it the one in most of its
texts, then the rarest in the corpus (``[TERM]`` where there is none). Pairs seen in fewer than
``support`` distinct texts are no evidence and are left alone.

Terms are the words ``[^\\x20\\x09-\\x0D]+`` that touch no pattern match,
compared without case and outer punctuation.

Defined results: null text counts as empty and stays null when sanitised;
equal texts are counted once but all sanitised; matches of one kind never
overlap, those of different kinds may, and the sanitised text then keeps the
first replacement; an empty table gives no rows; input columns are kept; an
entity in every distinct text (IC 0) is disclosed by no term.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerwire.functions.rows import compute_once
from tickerwire.llm.common import cut, text_key

# The patterns of the contract. The look-behinds and possessive
# repeats only spare attempts that must fail, so long runs take linear time:
# a match begins where the last one ended or at the begin of a run.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
# A text without this has no match of the kind.
_HINT = {"email": "@", "phone": "+"}
_PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
SUPPORT, GENERALISE_AT, REMOVE_AT = 3, 0.8, 0.95
SPAN = "array<struct<start: int, end: int, value: string>>"


def _valid(kind: str, value: Column) -> Column:
    digits = F.translate(value, "+ ().-", "")
    if kind == "ip":
        return value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _raw(kind: str, text: Column) -> Column:
    """struct<m: matches, g: gaps before, between and after them>, null where
    the text cannot hold any."""
    pattern = PATTERNS[kind]
    may = F.contains(text, F.lit(_HINT[kind])) if kind in _HINT else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[\x20-]?[0-9]){12}")
    return F.when(may, F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")))


_BLOCK = 64


def _running(values: Column, step: str, start: str = "0") -> Column:
    """Running totals of an int array by ``step`` (SQL of a and x), in blocks:
    near linear, where a fold that grows an array would be quadratic."""
    fold = lambda xs, x="x": f"aggregate({xs}, {start}, (a, {x}) -> {step.replace('x', x)})"
    block = f"transform(b, (v, i) -> get(transform(array({fold('slice(b, 1, i + 1)', 'y')}), x -> get(transform(array(base), a -> {step}), 0)), 0))"
    blocks = f"transform(sequence(0, cast((size(xs) - 1) / {_BLOCK} as int)), k -> slice(xs, k * {_BLOCK} + 1, {_BLOCK}))"
    based = f"get(transform(array({fold('slice(ts, 1, k)')}), base -> {block}), 0)"
    whole = (f"xs -> CASE WHEN size(xs) = 0 THEN xs ELSE get(transform(array({blocks}), bs -> get(transform(array(transform(bs, b -> {fold('b')})), "
             f"ts -> flatten(transform(bs, (b, k) -> {based}))), 0)), 0) END")
    return F.get(F.call_function("transform", F.array(values), F.expr(whole)), 0)


def _spans(kind: str, raw: Column) -> Column:
    """Valid matches with their places in code points."""
    ends = _running(F.zip_with(raw["m"], F.slice(raw["g"], 1, F.size(raw["m"])), lambda m, g: F.length(g) + F.length(m)), "a + x")
    placed = F.zip_with(raw["m"], ends, lambda m, e: F.struct((e - F.length(m)).alias("start"), e.alias("end"), m.alias("value")))
    return F.when(F.size(raw["m"]) > 0, F.filter(placed, lambda s: _valid(kind, s["value"]))).otherwise(F.array().cast(SPAN))


def find(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one column ``found``: struct of an array of
    struct<start, end, value> per kind."""
    given = F.coalesce(F.col(text), F.lit(""))
    packed = docs.select(F.struct("*").alias("row"), F.struct(*[_raw(k, given).alias(k) for k in KINDS]).alias("raw"))
    return packed.select("row.*", F.struct(*[
        F.when(F.col(f"raw.{k}").isNotNull(), _spans(k, F.col(f"raw.{k}"))).otherwise(F.array().cast(SPAN)).alias(k) for k in KINDS]).alias("found"))


def _entities() -> Column:
    """The values found, each with its kind."""
    named = lambda k: F.transform(F.col(f"found.{k}"), lambda s: F.concat(F.lit(k + ":"), s["value"]))
    return F.flatten(F.array(*[named(k) for k in KINDS]))


def _term(word: Column) -> Column:
    return F.lower(F.regexp_replace(word, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def _tokens(text: Column) -> Column:
    return F.split(text, r"[\x20\x09-\x0D]", -1)


def entities(found: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, entity) of the distinct texts that hold any, and those texts as
    (key, text), each written."""
    holders = cut(found.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"), F.array_distinct(_entities()).alias("entities"))
                  .where("size(entities) > 0").dropDuplicates(["key"]), "pii-holders")
    return cut(holders.select("key", F.explode_outer("entities").alias("entity")), "pii-entities"), holders.select("key", "text")


def _terms(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.transform(F.array_distinct(_tokens(F.coalesce(text, F.lit("")))), _term))


def _text_counts(docs: DataFrame, text: str) -> tuple[int, DataFrame]:
    """The number of distinct texts, and (term, n_t): in how many of them a
    term occurs. Every row's terms are counted, summed before the shuffle, and
    what repeated texts add is taken off again, so no text is shuffled but one
    of each that repeats, and the shuffle is bounded by the vocabulary."""
    keyed = docs.select(text_key(F.col(text)).alias("key"), F.col(text).alias("text"))
    copies = cut(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "pii-copies")
    n_texts = keyed.agg(F.count("*")).first()[0] - (copies.agg(F.sum(F.col("n") - 1)).first()[0] or 0)
    repeated = keyed.join(copies, "key").groupBy("key", "n").agg(F.first("text").alias("text"))
    each = lambda d, w: d.select(w.alias("w"), F.explode_outer(_terms(F.col("text"))).alias("term"))
    both = each(keyed, F.lit(1).cast("long")).unionByName(each(repeated, 1 - F.col("n")))
    return n_texts, both.where("term <> ''").groupBy("term").agg(F.sum("w").alias("n_t"))


def disclosing(docs: DataFrame, of_entity: DataFrame, holders: DataFrame, text: str = "text", support: int = SUPPORT,
               generalise_at: float = GENERALISE_AT) -> DataFrame:
    """(entity, term, disclosure, broader) of the terms that reveal an entity;
    ``broader``: what to say in their place, null where nothing is known."""
    known = of_entity.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= support)
    held = of_entity.join(known, "entity").select("key", "entity", "n_e")
    inside = cut(holders.join(held.select("key").distinct(), "key", "left_semi")
                 .select("key", F.explode_outer(_terms(F.col("text"))).alias("term")).where("term <> ''"), "pii-terms")
    pairs = cut(held.join(inside, "key").groupBy("entity", "n_e", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= support), "pii-pairs")
    if pairs.isEmpty():
        return pairs.select("entity", "term", F.lit(0.0).alias("disclosure"), F.lit(None).cast("string").alias("broader"))
    n_texts, spread = _text_counts(docs, text)
    spread = cut(spread.join(pairs.select("term").distinct(), "term", "left_semi"), "pii-spread")
    n = F.lit(float(n_texts))
    # an entity in every text has an information content of 0
    share = F.coalesce(F.try_divide(F.log2(n * F.col("n_et") / (F.col("n_e") * F.col("n_t"))), F.log2(n / F.col("n_e"))), F.lit(0.0))
    told = cut(pairs.join(spread, "term").select("entity", "term", "n_et", "n_t", share.alias("disclosure")), "pii-told")
    broader = (told.where(F.col("disclosure") < generalise_at).groupBy("entity")
               .agg(F.max_by("term", F.struct("n_et", -F.col("n_t"), "term")).alias("broader")))
    return told.where(F.col("disclosure") >= generalise_at).join(broader, "entity", "left").select("entity", "term", "disclosure", "broader")


_CHUNK = 1024


def _piece(chunks: Column, begin: Column, end: Column) -> Column:
    """Code points begin..end of a text given as chunks of ``_CHUNK``: the work
    is the piece's length, not its place in the text."""
    first = F.floor(begin / _CHUNK).cast("int")
    near = F.array_join(F.slice(chunks, first + 1, F.greatest(F.floor((end - 1) / _CHUNK).cast("int") - first + 1, F.lit(0))), "")
    return F.when(end > begin, F.substring(near, begin - first * _CHUNK + 1, end - begin)).otherwise("")


def sanitise(docs: DataFrame, text: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT,
             remove_at: float = REMOVE_AT) -> DataFrame:
    """Every row of ``docs`` as the struct ``row`` with ``found`` (see
    ``find``), ``terms`` (array of struct<start, end, replacement>) and the
    sanitised ``clean_text``. The time is near linear in a text's length and
    matches."""
    packed = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    of_entity, holders = entities(find(packed.select("text")))
    shown = cut(disclosing(packed, of_entity, holders, "text", support, generalise_at), "pii-disclosing")
    # the few texts that hold an entity with such terms get their lists; written,
    # so that Spark knows their size and moves no text where they can be broadcast
    bad = cut(of_entity.join(shown, "entity").groupBy("key", "term").agg(F.max(F.struct("disclosure", "broader")).alias("worst"))
              .groupBy("key").agg(F.collect_list(F.struct("term", "worst")).alias("bad")), "pii-bad")
    rows = find(packed.withColumn("key", text_key(F.col("text"))).join(bad, "key", "left"))
    words = _tokens(F.coalesce(F.col("text"), F.lit("")))
    base = F.flatten(F.array(*[F.col(f"found.{k}") for k in KINDS]))
    ends = _running(F.transform(words, lambda w: F.length(w) + 1), "a + x")
    placed = F.filter(F.zip_with(words, ends, lambda w, e: F.struct((e - 1 - F.length(w)).alias("start"), (e - 1).alias("end"), _term(w).alias("term"))),
                      lambda t: F.array_contains(F.col("bad.term"), t["term"]))
    free = F.filter(placed, lambda t: ~F.exists(base, lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])))
    worth = lambda t: F.element_at(F.map_from_entries("bad"), t["term"])
    terms = F.when(F.col("bad").isNotNull(), F.transform(free, lambda t: F.struct(
        t["start"].alias("start"), t["end"].alias("end"), F.when(worth(t)["disclosure"] >= remove_at, "")
        .otherwise(F.concat(F.lit("["), F.coalesce(worth(t)["broader"], F.lit("TERM")), F.lit("]"))).alias("replacement")))
    ).otherwise(F.array().cast("array<struct<start: int, end: int, replacement: string>>"))
    marked = rows.select("row", "text", "found", terms.alias("terms"))
    mask = lambda k: F.transform(F.col(f"found.{k}"), lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), F.lit(f"[{k.upper()}]").alias("replacement")))
    every = F.sort_array(F.concat(*[mask(k) for k in KINDS], F.col("terms")))
    marked = compute_once(marked, every=every)
    marked = compute_once(marked, reach=_running(F.transform("every", lambda s: s["end"]), "greatest(a, x)"),
                          chunks=F.when(F.size("every") > 0, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0))))
    # a span that begins before an earlier one ends leaves no replacement
    before = lambda i: F.when(i == 0, 0).otherwise(F.get("reach", i - 1))
    pieces = F.transform("every", lambda s, i: F.when(s["start"] >= before(i), F.concat(
        _piece(F.col("chunks"), before(i), s["start"]), s["replacement"])).otherwise(""))
    cleaned = F.concat(F.array_join(pieces, ""), _piece(F.col("chunks"), F.get("reach", F.size("reach") - 1), F.length("text")))
    return marked.select("row", "found", "terms", F.when(F.size("every") > 0, cleaned).otherwise(F.col("text")).alias("clean_text"))


def span_list(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))
