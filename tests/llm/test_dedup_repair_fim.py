"""Exact duplicates, conversation repair and fill-in-middle against brute
force: nulls, empty and very long texts, ties, repeated rows, empty tables and
columns whose names clash with the operators' own."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tickerwire.llm import content_sort, conversation_repair, fill_in_middle, queries
from tickerwire.llm.common import cut


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture()
def small_batches(spark):
    names = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions"
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("7", "false", "9")):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


# ---- exact duplicates -------------------------------------------------------

def corpus():
    r = random.Random(5)
    common = "the same beginning of very many texts " * 10
    out = [(i, "hot") for i in range(400)] + [(1000 + i, common + str(i % 90)) for i in range(300)]
    out += [(2000 + i, r.choice(["", None, " ", "a", "A", "é", "é", "\U0001f600"])) for i in range(60)]
    out += [(None, "hot"), (None, "alone"), (None, "pair"), (None, "pair"), (3000, "x"), (3000, "x"), (3001, "y" * 300_000), (3002, "y" * 300_000), (3003, "y" * 299_999 + "z")]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("keep", ["least", "greatest"])
def test_exact_dedup(spark, small_batches, keep):
    rows = corpus()
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, hash string, part int").repartition(5)
    got = content_sort.mark(df, keep=keep, carry=["hash", "doc_id"]).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    stays = {t: (min if keep == "least" else max)([i for i in ids if i is not None], default=None) for t, ids in groups.items()}
    want = Counter((i, stays[t or ""], len(groups[t or ""]), sha(t or "")) for i, t in rows)
    assert Counter((r.id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    kept = Counter(r.text_sha256 for r in got if r.kept)
    assert kept == Counter({sha(t): 1 for t in groups}) and all(r.id == r.keep_id for r in got if r.kept)
    assert all(tuple(r.row) == ("clash", r.id) for r in got)


def test_exact_dedup_rows_and_edges(spark):
    df = spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, None), (4, ""), (5, "c")], "doc_id long, text string")
    norm = lambda c: F.lower(F.regexp_replace(c, " +", " "))
    assert sorted(r.doc_id for r in content_sort.drop_copies(df, normalise=norm).collect()) == [1, 3, 5]
    assert content_sort.drop_copies(df).columns == df.columns
    assert content_sort.mark(df.limit(0)).count() == 0


def test_splitters_are_short(spark):
    """What Spark samples to the driver is the sort key, never a text."""
    rows = spark.createDataFrame([(1, "a", None)], "id long, text string, row string")
    plan = content_sort.content_order(rows, "least")._jdf.queryExecution().executedPlan().toString()
    keys = re.search(r"rangepartitioning\((.*?), \d+\)", plan).group(1)
    assert re.findall(r"(\w+)#", keys) == ["begin", "hash", "id"] and content_sort.PREFIX <= 256


# ---- conversation repair ----------------------------------------------------

def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        s = lambda v: " " if v is None else str(v)
        lot = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [] if lot == 0 else [(conv, turn, "user" if lot == 4 else role, text)] * (2 if lot == 3 else 1)
    return out


def codes_of(turns):
    seen, codes = set(), []
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "n" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        codes.append((fault, role[:1]))
    return codes


def cheapest(codes):
    """(cost, edits) by dynamic programming over strings, least of equals."""
    accept = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    inf = (10**9, "")
    best = {st: inf for st in accept}

    def inserts(layer):   # up to two insertions change every state
        for _ in range(4):
            for st in accept:
                for x in "ua":
                    if x in accept[st]:
                        c, e = layer[accept[st][x]]
                        layer[st] = min(layer[st], (c + 5, "I" + e))
        return layer
    best[""], best["a"] = (0, ""), (0, "")
    best = inserts(best)
    for fault, role in reversed(codes):
        now = {}
        for st in accept:
            options = [(best[st][0] + 2, "D" + best[st][1])]
            if fault not in "bd":
                more = 5 if fault == "t" else 0
                if role in accept[st]:
                    to = best[accept[st][role]]
                    options.append((to[0] + more, "K" + to[1]))
                for x in "ua":
                    if x in accept[st]:
                        to = best[accept[st][x]]
                        options.append((to[0] + 1 + more, "R" + to[1]))
            now[st] = min(options)
        best = inserts(now)
    return best[""]


def test_auction_finds_the_least_cheapest_edits():
    kinds = [(f, r) for f in "bdtn" for r in ("s", "u", "a", "t", "")]
    for n in range(3):
        for codes in itertools.product(kinds, repeat=n):
            assert conversation_repair.repair_string(list(codes)) == cheapest(codes), codes
    r = random.Random(1)
    for _ in range(1500):
        codes = [(r.choice("bdtnnnnn"), r.choice("suuuaaat")) for _ in range(r.randrange(3, 40))]
        assert conversation_repair.repair_string(codes) == cheapest(codes), codes


def test_auction_prices_are_dual_feasible_and_cheap():
    r = random.Random(2)
    codes = [(r.choice("bdtnnn"), r.choice("sua")) for _ in range(20000)]
    p = conversation_repair.prices(codes)
    for i, code in enumerate(codes):
        for s in range(4):
            out = [(c, p[i + 1][t]) for _, c, t in conversation_repair.arcs(*code, s)] + [(5, p[i][conversation_repair.NEXT[s]])]
            assert p[i][s] == min(c + q for c, q in out)


CONVERSATIONS = [(c, t, "user" if t % 2 == 0 else "assistant", f"say {c} {t}.") for c in range(60) for t in range(c % 7)]
CONVERSATIONS += [(100, t, r, x) for t, (r, x) in enumerate([("system", "be."), ("user", "a?"), ("user", "a?"), ("tool", "x"), ("assistant", "cut off"), (None, "r."), ("user", None)])]
CONVERSATIONS += [(101, None, "user", "late."), (101, 5, "assistant", "b!"), (101, 5, "user", "tie."), (101, 5, "user", "tie."), (101, 9, "", "\t\n \x0b"), (101, 9, "user", " ")]
CONVERSATIONS += [(None, 0, "user", "n."), (None, 1, "assistant", "m."), (102, None, None, None)]
CONVERSATIONS += [(103, t, random.Random(t).choice(["user", "assistant", "system"]), f"w{t % 500}" + random.Random(-t).choice([".", "", " "])) for t in range(3000)]


def repaired(turns, edits):
    out, at, state = [], 0, ""
    for e in edits:
        role = text = None
        if e != "I":
            _, role, text = turns[at]
            at += 1
        if e == "D":
            continue
        if e in "IR":
            role, text = ("assistant" if state == "u" else "user"), "" if e == "I" else text
        state = role[:1]
        out.append(f"{role}:{text}")
    assert at == len(turns) and re.fullmatch("(s?(ua)+)?", "".join(x[:1] for x in out))
    return out


def test_conversation_repair(spark, small_batches):
    df = spark.createDataFrame([(*r, "clash", 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, audit string, gone int").repartition(4)
    rows = queries.damaged(df)
    got = {r.conv_id: r for r in conversation_repair.repair_digests(rows, gone=F.col("gone")).collect()}
    by = {c: [] for c, *_ in CONVERSATIONS}
    for c, t, role, text in damage(CONVERSATIONS):
        by[c].append((t, role, text))
    assert set(got) == set(by)
    turns_of = defaultdict(list)
    for r in conversation_repair.repair(rows, gone=F.col("gone")).orderBy("position").collect():
        turns_of[r.conv_id].append(f"{r.role}:{r.text}")
    for c, turns in by.items():
        turns.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.md5(x[2].encode()).digest()))
        codes = codes_of(turns)
        cost, audit = cheapest(codes)
        numbers = [t for t, *_ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[1] + b[1] not in ("su", "ua", "au") for a, b in zip(codes, codes[1:]))
        faults = [sum(f == k for f, _ in codes) for k in "bdt"]
        lines = repaired(turns, audit)
        assert tuple(got[c]) == (c, gaps, *faults, illegal, cost, audit, sha("\n".join(lines))), c
        assert turns_of.get(c, []) == lines
    assert got[102].cost == (2 if by[102] else 0)


def test_conversation_repair_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    none = spark.createDataFrame([], schema)
    assert conversation_repair.repair_digests(none).count() == 0 and conversation_repair.repair(none).count() == 0
    gone = spark.createDataFrame([(1, 0, "user", "x"), (2, 0, "user", "x" * 10**6)], schema)
    got = {r.conv_id: r for r in conversation_repair.repair_digests(gone, gone=F.col("conv_id") == 1).collect()}
    assert tuple(got[1]) == (1, 0, 0, 0, 0, 0, 0, "", sha("")) and got[2].audit == "D"


# ---- fill-in-middle ---------------------------------------------------------

def fim(doc_id, text):
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    n, h = len(units), sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    r = random.Random(3)
    texts = [None, "", "a", " ", "<P>", "x <S", "<M", "<P<S>", "a<M>b", "<", "S><P", "é" * 50_000, "A" * 300_000, "\n\r\x00 ", "\U0001f600b" * 40_000]
    texts += ["".join(r.choice("ab Zé1<\U0001f600\n>SPM") for _ in range(r.randrange(400))) for _ in range(300)]
    texts += ["".join(r.choice(["word", "A" * 1000, " ", "ü", "9"]) for _ in range(2000)) for _ in range(4)]
    return texts


def test_fill_in_middle(spark):
    rows = [(i, t) for i, t in enumerate(fim_texts())] + [(None, "no number"), (7, "x <S"), (7, "x <S")]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, form string, n int").repartition(4)
    stored = cut(fill_in_middle.store(df), "t")
    made = fill_in_middle.transform(stored)
    got = Counter(tuple(r) for r in fill_in_middle.digests(made).collect())
    want = Counter()
    for i, t in rows:
        n, form, p, m, out = fim(i, t or "")
        want[(i, n, form, p, m, sha(out), sha(t or ""))] += 1
    assert got == want and {"psm", "spm", "plain"} == {k[2] for k in want}
    texts = {(r.id, r.output, r.restored) for r in fill_in_middle.texts(made).collect()}
    assert texts == {(i, fim(i, t or "")[4], t or "") for i, t in rows}
    assert max(r.k for r in stored.select(F.size("frames").alias("k")).collect()) > 3
    assert fill_in_middle.digests(fill_in_middle.transform(fill_in_middle.store(df.limit(0)))).count() == 0


def test_frames_of_few_bytes(monkeypatch):
    """Cuts, marks and runs of letters across every frame border."""
    monkeypatch.setattr(fill_in_middle, "FRAME", 3)
    for i, text in enumerate(t for t in fim_texts() if t and len(t) < 500):
        data = text.encode()
        frames, n, chars = fill_in_middle.frames_of(data)
        units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
        assert (n, chars) == (len(units), len(text)) and b"".join(fill_in_middle.pieces(frames, 0, len(data))) == data
        at = 0
        for k, unit in enumerate([*units, ""]):
            assert fill_in_middle.place(frames, k, n, chars, len(data)) == (len(text[:at].encode()), at)
            at += len(unit)
        row = {"id": i, "n": n, "chars": chars, "bytes": len(data), "marked": any(m in data for m in fill_in_middle.MARKS), "frames": frames}
        made = next(fill_in_middle._transform(1, 101, 50)(iter([FakeBatch([row])])))
        one = {name: made.column(k)[0].as_py() for k, name in enumerate(made.schema.names)}
        assert b"".join(fill_in_middle.restored(one["output"], one["form"], one["bytes"])) == data


class FakeBatch:
    def __init__(self, rows):
        self.rows, self.num_rows = rows, len(rows)

    def slice(self, k, n):
        return FakeBatch(self.rows[k:k + n])

    def to_pylist(self):
        return self.rows
