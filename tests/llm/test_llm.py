"""Corpus operators against brute force, exact round trips and held-out rows.

The fixtures hold nulls, empty texts, repeated rows, ties and an extra column
whose name clashes with the operators' own ones."""

import base64
import gzip
import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from tickerwire.llm import chat, common, decontaminate, minhash, oracle, packing, pii, quality, queries, suffixes, toxicity, url_filters, warc
from tickerwire.llm.common import text_key

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, row string"


def words(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return [f"w{r.randrange(vocabulary)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    base = words(200, 1)
    near = base[:60] + ["other"] + base[61:]
    passage = words(60, 2)
    out = [
        (1, " ".join(base)), (2, " ".join(base)), (3, " ".join(near)), (4, " ".join(words(80, 3) + passage + words(30, 4))),
        (5, " ".join(words(40, 5) + passage)), (6, None), (7, ""), (8, "  \n "), (9, "a b"), (10, "a  b"), (10, "a  b"), (None, "a  b"),
        (11, " ".join(words(30000, 6, 10**6))), (12, "mail x.y@z.org, ip 10.0.0.1 or 1.2.3.400 a@b.c_d@e.f call +1 (017) 555-7713 or 4111 1111 1111 1111 end"),
        (13, "x\n\nx\n \nx y\nx y # $"), (14, "one two three four five " * 20),
    ]
    return [(i, t, None if i == 9 else "en", None if i == 9 else f"s{(i or 0) % 2}", 0, "k", "r") for i, t in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_sql_queries(spark):
    con = duckdb.connect()
    for t in ("pages", "conversations", "documents"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, sql in oracle.oracle_sql().items():
        got = queries.queries()[name](spark, SMALL)
        want = con.sql(sql)
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda r: [str(x) for x in r]
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect()), key=key) == sorted(
            want.select(*sorted(want.columns)).fetchall(), key=key), name


def test_url_rules(spark):
    given = [(1, None), (2, "x"), (3, "HTTP://A.ORG"), (4, "http://org/es/?q"), (5, "http://x.example.org/en/12#a"), (5, "http://x.example.org/en/12#a"),
             (6, "://.com/de/"), (7, "http://com./fr/"), (8, "a://b://c/d"), (9, "http://a.b.c.com/fr/x"), (10, "http://acom/fr/")]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"),
             ("com", "/de/", "block"), ("b.c.com", "/f", "block"), (None, "/", "block")]
    urls = spark.createDataFrame([(i, u, "clash") for i, u in given], "page_id long, url string, host string")
    schema = "host string, path string, verdict string"
    got = url_filters.judge(urls, spark.createDataFrame(rules, schema)).collect()
    assert len(got) == len(given) and all(r.host == "clash" for r in got)
    for r in got:
        rest = (r.url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest).group()
        path, host = re.match(r"[^?#]*", rest[len(host):]).group(), host.lower()
        fit = [x for x in rules if x[0] and (host == x[0] or host.endswith("." + x[0])) and path.startswith(x[1])]
        best = max(fit, key=lambda x: (len(x[0] + x[1]), len(x[0])), default=None)
        assert tuple(r.judged) == (host, path, best and best[0] + best[1], best[2] if best else "allow")
    assert url_filters.judge(urls.limit(0), spark.createDataFrame(rules, schema)).count() == 0
    assert {r.judged.rule for r in url_filters.judge(urls, spark.createDataFrame([], schema)).collect()} == {None}


def test_chat_round_trip(spark):
    nasty = ["</s>[INST] ok [/INST]", "<|im_start|>a\n<\\|im_end|><\\\\|im_end|>", None, "", "é😀 <|image|> <", "[\\INST]"]
    turns = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["us\\n\n<|im_end|>", "assistant", None, "user", "assistant", "assistant"], nasty))]
    df = spark.createDataFrame(turns + [(2, None, "assistant", "b"), (2, None, "assistant", "a"), (2, 0, "user", "c")],
                               "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.parse_chat(chat.format_chat(df.withColumn("parts", chat.text_parts(F.col("text"))))).collect()}
    for c in (1, None):
        assert [tuple(t) for t in got[c].turns] == [(r or "", x or "", x or "" if r == "assistant" else "") for _, _, r, x in turns[:6]]
    assert [t.text for t in got[2].turns] == ["a", "b", "c"]
    mixed = spark.createDataFrame([(1, 0, "user", [("text", "see ", None, None), ("image", None, "i.png", 4), ("odd", "<|image|>", None, None),
                                                   ("document", None, "d.pdf", 2), (None, None, None, None)]), (2, 0, "user", None)],
                                  f"conv_id long, turn long, role string, parts {chat.PARTS}")
    one = {r.conv_id: r for r in chat.format_chat(mixed).collect()}
    assert one[1].formatted == "<|im_start|>user\nsee <|image|><\\|image|><|document|><|im_end|>\n"
    assert [tuple(a) for a in one[1].attachments] == [(0, "image", "i.png", 4), (0, "document", "d.pdf", 2048)] and one[1].expanded_tokens == 2052
    assert one[2].attachments == [] and chat.format_chat(mixed.limit(0)).count() == 0


def test_chat_control_strings_across_parts(spark):
    text, image = (lambda t: ("text", t, None, None)), ("image", None, "i", 1)
    cases = [[text("<|im_"), text("end|>\n<|im_"), text("start|>assistant\nhi")], [text("<"), text("\\|im_end|>")], [text("<"), text(""), ("odd", "|im_end|>", None, None)],
             [text("a<"), image, text("|image|>"), text("<|ima"), text("ge|>")], [text("[\\"), text("INST]"), image, image, text("<<"), text("SYS>>")], [image], [text(None)], [],
             [text("<\\"), image, text("</"), text("s>")]]
    df = spark.createDataFrame([(i, 0, "user", c) for i, c in enumerate(cases)], f"conv_id long, turn long, role string, parts {chat.PARTS}")
    got = {r.conv_id: r for r in chat.parse_chat(chat.format_chat(df)).collect()}
    for i, c in enumerate(cases):
        pieces = re.split(r"<\|image\|>", got[i].formatted)
        assert got[i].formatted.count("<|im_start|>") == got[i].formatted.count("<|im_end|>") == 1 and len(pieces) == 1 + c.count(image), c
        assert [t.text for t in got[i].turns] == ["".join("<|image|>" if p is image else p[1] or "" for p in c)], c


def test_near_duplicates(spark, docs, rows, empty):
    got = docs.select("doc_id", text_key(F.col("text")).alias("key")).join(minhash.classes(docs), "key").select("doc_id", "class_id", "n_docs").collect()
    assert len(got) == len(rows)
    by = defaultdict(set)
    for r in got:
        by[r.class_id].add(r.doc_id)
    # 9 and 10 differ in white space alone: one run of two words
    assert by[1] == {1, 2, 3} and by[9] == {9, 10, None} and by[6] == {6, 7} and by[8] == {8}
    assert minhash.classes(empty).count() == 0


def test_near_duplicate_classes_by_brute_force(spark):
    """A large group of drifting copies, most pairs of which are not similar,
    texts that share a passage only, and unrelated ones: single linkage."""
    def grams(t):
        return Counter(tuple(t[i:i + 5]) for i in range(len(t) - 4))

    def similar(a, b):
        return (a & b).total() >= 0.8 * (a | b).total()
    r = random.Random(11)
    base, passage = words(150, 70), words(60, 71)
    texts = []
    for i in range(160):   # each has some of twelve edits
        t = list(base)
        for e in r.sample(range(12), r.randrange(6)):
            t[12 * e + 5] = f"edit{e}"
        texts.append(t)
    texts += [words(40, 500 + i, 10**6) + passage + words(20, 900 + i, 10**6) for i in range(120)]
    texts += [words(100, 2000 + i, 10**6) for i in range(60)]
    bags = [grams(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similar(bags[i], bags[j])]
    for i, j in links:
        root[find(i)] = find(j)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.class_id for r in df.select("doc_id", text_key(F.col("text")).alias("key")).join(minhash.classes(df), "key").collect()}
    found = sum(got[i] == got[j] for i, j in links)
    print(f"links found: {found} of {len(links)}")
    same = lambda of: {frozenset(i for i in range(len(texts)) if of(i) == k) for k in {of(i) for i in range(len(texts))}}
    assert len(links) > 1000 and found >= 0.999 * len(links)
    assert same(got.get) == same(find)


def test_blocks_of_texts_are_compared_in_full(spark, monkeypatch):
    """Without rounds all links come from blocks of a few texts."""
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    monkeypatch.setattr(minhash, "BLOCK", 7)
    base = words(60, 5)
    texts = [base[:i % 9] + base[i % 9 + 1:] + [f"e{i % 4}"] for i in range(90)] + [words(50, i) for i in range(9)] + [["a"] * 30, ["a"] * 31, ["a"]]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in df.select("doc_id", text_key(F.col("text")).alias("key")).join(minhash.classes(df), "key").collect()}
    assert {got[i] for i in range(90)} == {0} and [got[i] for i in range(90, 102)] == [*range(90, 99), 99, 99, 101]


def test_common_runs_by_brute_force():
    import numpy as np
    r = random.Random(3)
    rows = [minhash.mix(np.array([r.randrange(3) for _ in range(r.choice([0, 1, 4, 5, 40]))], np.uint64)) for _ in range(20)]
    got = minhash.common(rows, chunk=5)
    bags = [Counter(dict(zip(*(x.tolist() for x in minhash.shingles(w))))) for w in rows]
    for i, a in enumerate(bags):
        for j, b in enumerate(bags):
            assert got[i, j] == (a & b).total() or i == j, (i, j)


def test_sketches_differ_by_similarity():
    import numpy as np
    h = minhash.mix(np.arange(4000, dtype=np.uint64))
    one = lambda a, b: (h[a:b], np.ones(b - a, int))
    s = minhash.sketches(minhash.signatures([one(0, 1000), one(110, 1110), one(0, 1000), one(2000, 3000)]))
    apart = [sum(bin(int(x) & (1 << 64) - 1).count("1") for x in s[0] ^ s[k]) for k in (1, 2, 3)]
    assert apart[0] < 50 and apart[1] == 0 and apart[2] > 80


def test_dart_signature_estimates_weighted_similarity():
    import numpy as np
    h = minhash.mix(np.arange(2000, dtype=np.uint64))
    ones = lambda a, b: (h[a:b], np.ones(b - a, int))
    s = minhash.signatures([ones(0, 1000), ones(100, 1100), (h[:50], np.full(50, 7)), (h[:50], np.full(50, 10)), ones(0, 1)])
    assert abs((s[0] == s[1]).mean() - 900 / 1100) < 0.1 and abs((s[2] == s[3]).mean() - 0.7) < 0.12 and np.isfinite(s).all()


def test_decontamination(spark, empty):
    item = words(40, 9)
    edited = item[:39] + ["x"]
    half = item[:20] + words(20, 11)
    texts = [(1, " ".join(words(50, 10) + item + words(9, 12))), (2, " ".join(w.upper() + "," for w in edited)), (3, " ".join(half)), (4, None), (5, ""),
             (6, " ".join(words(500, 13))), (7, " ".join(item)), (7, " ".join(item))]
    df = spark.createDataFrame([(i, t, "clash") for i, t in texts], "doc_id long, text string, key string")
    items = spark.createDataFrame([(0, " ".join(item)), (1, "too short"), (2, None), (3, " ".join(item))], "item_id long, text string")
    got = Counter((r.doc_id, r.item_id, r.begin) for r in decontaminate.find(df, items).collect())
    assert got == Counter({(d, i, b): n for i in (0, 3) for d, b, n in ((1, 50, 1), (2, 0, 1), (7, 0, 2))})
    assert decontaminate.find(df, items.limit(0)).count() == 0 and decontaminate.find(empty, items).count() == 0


def test_decontamination_of_cut_items(spark):
    # items quoted with their first or last words replaced, similarity at and above the limit
    def similarity(a, b):
        a, b = (Counter(tuple(x[i:i + 5]) for i in range(len(x) - 4)) for x in (a, b))
        return (a & b).total() / (a | b).total()
    items, texts, want = [], [], Counter()
    for i in range(120):
        item = words(40 + 9 * (i % 10), 1000 + i, 10**6)
        items.append((i, " ".join(item)))
        edge = (len(item) - 4) // 9
        for k, lost in enumerate((edge - 1, edge, edge + 1)):
            other = words(lost, 5000 + 3 * i + k, 10**6)
            for side, text in enumerate((other + item[lost:], item[:len(item) - lost] + other)):
                doc = 10 * i + 2 * k + side
                texts.append((doc, " ".join(text)))
                if similarity(text, item) >= 0.8:
                    want[(doc, i)] += 1
    df, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.item_id) for r in decontaminate.find(df, bench).collect())
    assert got == want and 400 < len(want) < 720


def test_decontamination_against_every_window(spark):
    """Items quoted whole, edited, turned round and scattered in long texts,
    against all windows of each text."""
    def grams(t):
        return Counter(tuple(t[i:i + 5]) for i in range(len(t) - 4))

    def similarity(a, b):
        a, b = grams(a), grams(b)
        return (a & b).total() / ((a | b).total() or 1)
    r = random.Random(21)
    items = [words(r.choice([5, 6, 25, 50, 50, 81]), 300 + i, 10**6) for i in range(24)]
    items.append(["again"] * 30)
    texts = []
    for i, item in enumerate(items):
        half, k = len(item) // 2, max(len(item) // 12, 1)
        forms = [item[half:] + item[:half], item[k:] + words(k, 700 + i, 10**6), item[:half] + ["in"] + item[half:], item[:-k], item[:half] * 2,
                 [w if (j + 3) % 17 else "x" for j, w in enumerate(item)], item[:len(item) // 3], item * 2, item[:len(item) * 9 // 10]]
        for f, form in enumerate(forms):
            before = words(r.randrange(60), 9000 + 10 * i + f, 10**6)
            texts.append(before + form + words(r.choice([0, 0, 3, 40]), 12000 + 10 * i + f, 10**6))
    texts.append(words(20000, 77, 10**6) + items[3][25:] + items[3][:25] + words(20000, 78, 10**6))
    texts += [["again"] * 27, ["again"] * 400]
    want = {}
    for d, t in enumerate(texts):
        where = {}
        for i in range(len(t) - 4):
            where.setdefault(tuple(t[i:i + 5]), []).append(i)
        for k, item in enumerate(items):
            if not any(g in where for g in grams(item)):
                continue
            last = max(len(t) - len(item), 0)
            near = range(last + 1) if len(t) < 2000 else {min(max(0, i - j), last) for g in grams(item) for i in where.get(g, []) for j in range(len(item))}
            broken = {i - j for j in range(len(item) - 4) for i in where.get(tuple(item[j:j + 5]), []) if i - j > last}
            best = max(similarity(t[b:b + len(item)], item) for b in [*near, *broken])
            if best >= 0.8:
                want[(d, k)] = round(best, 9)
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id long, text string")
    got = decontaminate.find(df, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want and len(got) == len(want) > 60
    for r in got:
        assert abs(similarity(texts[r.doc_id][r.begin:r.begin + len(items[r.item_id])], items[r.item_id]) - r.similarity) < 1e-9
    assert any(d == len(texts) - 3 for d, _ in want)


def test_warc(spark):
    given = [(3, "u", "x"), (2, "u\r\nv%", "x"), (2, "u", "x"), (None, None, "x"), (5, "k", None), (6, "k", ""), (7, "k", "é\r\n\r\nWARC/1.1")]
    df = spark.createDataFrame([(*g, "clash") for g in given], "page_id long, url string, html string, offset string").repartition(2)
    folder = folder_of_index = warc.archive_folder(spark)
    index = warc.write(df, folder)
    got = warc.read(index, folder).collect()
    assert Counter((r.id, r.url) for r in got) == Counter((a, b) for a, b, _ in given)
    for r in got:
        payload = next((c or "").encode() for a, b, c in given if (a, b) == (r.id, r.url))
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        assert r.payload == (payload if r.record_type == "response" else None)
    kinds = Counter((r.id, r.record_type, r.refers_to) for r in got)
    assert kinds == Counter([(2, "response", None), (2, "revisit", 2), (3, "revisit", 2), (None, "revisit", 2), (5, "response", None), (6, "revisit", 5), (7, "response", None)])
    # the same rows in another order and number of tasks give the same records
    def bodies(df):
        folder = warc.archive_folder(spark)
        index = warc.write(df, folder, date="2024-01-02T03:04:05Z").collect()
        out = []
        for r in index:
            with open(f"{folder.removeprefix('file:')}/{r.file}", "rb") as f:
                f.seek(r.offset)
                out.append(gzip.decompress(f.read(r.length)))
        return sorted(out)
    twice = df.unionByName(df)
    records = bodies(twice)
    assert records == bodies(twice.repartition(5)) and len(records) == 2 * len(given)
    heads = [dict(x.split(": ", 1) for x in r.partition(b"\r\n\r\n")[0].decode().split("\r\n")[1:]) for r in records]
    responses = {h["WARC-Record-ID"]: h for h in heads if h["WARC-Type"] == "response"}
    assert len(responses) == 3 and {h["WARC-Date"] for h in heads} == {"2024-01-02T03:04:05Z"}
    for h in heads:
        if h["WARC-Type"] == "revisit":
            assert responses[h["WARC-Refers-To"]]["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
    assert {h.get("WARC-Target-URI") for h in heads} == {"u", "u%0D%0Av%", None, "k"}
    short = warc.read(warc.write(twice, folder := warc.archive_folder(spark), least=2), folder).collect()
    assert Counter(r.record_type for r in short) == {"response": 13, "revisit": 1}
    some = warc.read(index.where("id = 7"), folder_of_index).collect()
    assert len(some) == 1 and some[0].payload.decode() == "é\r\n\r\nWARC/1.1"
    assert warc.read(warc.write(df.limit(0), warc.archive_folder(spark)), folder).count() == 0


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


def test_personal_data(spark, docs, empty):
    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
                "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    more = spark.createDataFrame([(100 + i, t, "en", "s", 0, "k", "r") for i, t in enumerate(
        ["1.2.3.4.5.6.7.8 0001.2.3.255", "é😀 a@b.c.d-e x@y", "+12 345-678 90+1234567890123456", "4" * 20 + " 4111-1111-1111-1111", "a@" * 50 + "b.c"])], DOCS)
    got = pii.sanitise(docs.unionByName(more)).select("row.doc_id", "row.text", "found", "clean_text").collect()
    for r in got:
        for kind, p in patterns.items():
            want = []
            for m in re.finditer(p, r.text or ""):
                digits = re.sub(r"\D", "", m.group())
                if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.group().split(".")),  # noqa: B023
                    "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]():  # noqa: B023
                    want.append((m.start(), m.end(), m.group()))
            assert [tuple(s) for s in r.found[kind]] == want, (r.doc_id, kind)
    clean = {r.doc_id: r.clean_text for r in got}
    assert clean[6] is None and clean[12] == "mail [EMAIL], ip [IP] or 1.2.3.400 [EMAIL][EMAIL] call [PHONE] or [CARD] end"
    assert pii.sanitise(empty).count() == 0


def test_disclosing_terms_go(spark):
    # "nickname" occurs only beside the address, "common" everywhere
    texts = [f"common w{i} Nickname, write boss@corp.example now{i}" for i in range(4)] + [f"common w{i} filler{i}" for i in range(40)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in pii.sanitise(df).select("row.doc_id", "clean_text").collect()}
    assert got[0] == "common w0   [EMAIL] now0" and got[10] == texts[10]


def test_disclosing_terms_are_generalised(spark):
    """Against the definition: counts over distinct texts, the broader term by them."""
    import math
    r = random.Random(6)
    texts = []
    for i in range(300):
        entity = r.choice([None] * 5 + ["boss@corp.example", "10.0.0.7", "x@y.zz"])
        near = {"boss@corp.example": ["Chief,", "office"], "10.0.0.7": ["server", "rack"], "x@y.zz": ["chief", "rack"], None: []}[entity]
        more = [w for w in near if r.random() < 0.9] + [w for w in ("office", "rack", "common", "server") if r.random() < 0.15]
        texts.append(" ".join([f"w{r.randrange(40)}" for _ in range(6)] + more + ([entity] if entity else [])))
    texts += texts[:60]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    distinct = sorted(set(texts))
    term = lambda w: re.sub(r"^[\W_]+|[\W_]+$", "", w).lower()
    bags = {t: {term(w) for w in t.split()} - {""} for t in distinct}
    entities = {"boss@corp.example": "[EMAIL]", "10.0.0.7": "[IP]", "x@y.zz": "[EMAIL]"}
    n, n_t = len(distinct), Counter(w for t in distinct for w in bags[t])
    bad = {}
    for e in entities:
        held = [t for t in distinct if e in t.split()]
        both = Counter(w for t in held for w in bags[t])
        share = {w: math.log2(n * k / (len(held) * n_t[w])) / math.log2(n / len(held)) for w, k in both.items() if k >= 3}
        broad = max((both[w], -n_t[w], w) for w in share if share[w] < 0.6)[2]
        for w in share:
            if share[w] >= 0.6:
                bad.setdefault(w, {})[e] = (share[w], broad)
    seen = set()
    for row in pii.sanitise(df, generalise_at=0.6, remove_at=0.9).select("row.*", "clean_text").collect():
        out = []
        for w in row.text.split(" "):
            worst = max((bad[term(w)][e] for e in bad.get(term(w), {}) if e in row.text.split()), default=None)
            if w in entities:
                out.append(entities[w])
            elif worst:
                out.append("" if worst[0] >= 0.9 else f"[{worst[1]}]")
                seen.add(out[-1])
            else:
                out.append(w)
        assert row.clean_text == " ".join(out)
    assert any(x.startswith("[") for x in seen)


def test_entity_in_every_text_discloses_nothing(spark):
    df = spark.createDataFrame([(i, f"nickname w{i} boss@corp.example") for i in range(4)], "doc_id long, text string")
    got = {r.doc_id: r.clean_text for r in pii.sanitise(df).select("row.doc_id", "clean_text").collect()}
    assert got == {i: f"nickname w{i} [EMAIL]" for i in range(4)}


def test_toxicity_held_out(spark, empty):
    r = random.Random(5)
    data = []
    for i in range(600):
        bad = i % 6 == 0
        text = words(40, i, 400) + (["scoundrel", "rascal"][: 1 + i % 2] if bad else [])
        r.shuffle(text)
        data.append((i, " ".join(text), int(bad), int(i % 7 > 0)))
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int, quality int")
    labels = df.select("doc_id", "toxic", "quality")
    models = toxicity.train(df, labels.where("doc_id % 5 > 0"), queries.categories())
    held = toxicity.score(df, models).where("row.doc_id % 5 = 0").select("row.toxic", F.col("p")[1].alias("p")).collect()
    wrong = sum((x.p >= toxicity.THRESHOLD) != bool(x.toxic) for x in held)
    assert wrong <= 0.03 * len(held)
    odd = toxicity.score(spark.createDataFrame([(1, None, "c"), (2, "", "c")], "doc_id long, text string, p string"), models).collect()
    assert all(0 < x.p[1] < 0.5 and x.row.p == "c" for x in odd)
    assert toxicity.score(empty, toxicity.train(df, labels.limit(0), queries.categories())).count() == 0


def test_repeated_passages(spark, docs, rows, empty):
    texts = {}
    for i, t, *_ in rows:
        texts.setdefault(t or "", []).append(i)
    places = defaultdict(list)
    for t in texts:
        w = tokens(t)
        for i in range(len(w) - 49):
            places[tuple(w[i:i + 50])].append((t, i))
    at = defaultdict(set)
    for v in places.values():
        for t, i in v if len(v) > 1 else []:
            at[t].add(i)
    want = Counter()
    for t, ids in texts.items():
        spans, begin = [], None
        for i in sorted(at[t]):
            begin = i if begin is None else begin
            if i + 1 not in at[t]:
                spans.append((begin, i + 50))
                begin = None
        if len(ids) > 1 and len(tokens(t)) >= 50:
            spans.append((0, len(tokens(t))))
        want.update((d, *s) for d in ids for s in spans)
    got = suffixes.repeats(docs).collect()
    assert Counter((r.doc_id, r.begin, r.end) for r in got) == want and want[(4, 80, 140)]
    assert {(r.doc_id, r.removable) for r in got if r.doc_id in (4, 5)} == {(4, False), (5, True)}
    assert suffixes.repeats(empty).count() == 0


def test_removable_parts_keep_a_copy(spark):
    # staggered passages: the first place changes inside a span, both ways round
    x, y = words(200, 70, 10**6), words(160, 71, 10**6)
    texts = {1: x[:100], 5: x, 9: x[50:], 11: y[:90], 12: y[60:] + y[:90], 13: words(70, 72, 10**6) + y[30:], 14: ["a", "b", "c"] * 40, 15: x}
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "doc_id long, text string")
    first, want = {}, defaultdict(set)
    for i, t in texts.items():   # ascending ids
        for at in range(len(t) - 49):
            if first.setdefault(tuple(t[at:at + 50]), (i, at)) != (i, at):
                want[i].update(range(at, at + 50))
    got, gone = suffixes.repeats(df).collect(), defaultdict(set)
    for r in got:
        text = " ".join(texts[r.doc_id])
        assert (r.begin, r.end, r.first_doc_id, r.first_begin) == (r.parts[0].begin, r.parts[-1].end, r.parts[0].first_doc_id, r.parts[0].first_begin)
        assert r.removable == all(p.removable for p in r.parts)
        for p in r.parts:
            n = p.end - p.begin
            assert texts[p.first_doc_id][p.first_begin:p.first_begin + n] == texts[r.doc_id][p.begin:p.end]
            assert text[p.char_begin:p.char_end].split() == texts[r.doc_id][p.begin:p.end]
            gone[r.doc_id].update(range(p.begin, p.end) if p.removable else ())
    assert {i: v for i, v in gone.items() if v} == dict(want)
    kept = {w for i, t in texts.items() for at, w in enumerate(t) if at not in gone[i]}
    assert kept == {w for t in texts.values() for w in t}
    assert not next(r for r in got if r.doc_id == 5).removable and want[5] == set(range(100)) and want[9] == set(range(150))


def test_personal_data_many_matches_in_one_text(spark):
    """Linear in matches and length: spans past block and chunk borders."""
    r = random.Random(8)
    texts = [" ".join(r.choice([f"10.{r.randrange(300)}.1.2", "a@b.c", "w\U0001f600é" * r.randrange(400), "+12345678901"]) for _ in range(n)) for n in (63, 64, 65, 129, 3000)]
    texts.append(" ".join(f"10.0.{i % 250}.7" for i in range(20000)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    start = time.time()
    for row in pii.sanitise(df, support=10**6).select("row.*", "found", "clean_text").collect():
        spans = sorted((s.start, s.end, k) for k in pii.KINDS for s in row.found[k])
        assert all(row.text[s.start:s.end] == s.value for k in pii.KINDS for s in row.found[k])
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [row.text[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        assert row.clean_text == "".join(out) + row.text[at:]
    assert time.time() - start < 90 and len(spans) > 0


def test_quality(spark, docs, rows, empty):
    got = quality.judge(docs).select("row.*", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == len(rows)
    for r in got:
        w, t = tokens(r.text), r.text or ""
        windows = defaultdict(list)
        for i in range(len(w) - 4):
            windows[tuple(w[i:i + 5])].append(i)
        covered = {j for v in windows.values() if len(v) > 1 for i in v for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if tokens(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_thresholds_follow_the_group(spark):
    # '#' is usual in one source and odd in the other
    data = [(i, " ".join(words(50, i) + ([f"#{j}" for j in range(20)] if s == "code" else [])), "en", s) for i, s in enumerate(["code", "news"] * 150)]
    data.append((1000, " ".join(words(50, 7) + [f"#{j}" for j in range(20)]), "en", "news"))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).select("row.doc_id", "kept").collect()}
    assert not got[1000] and sum(got.values()) >= 295


def test_packing(spark, docs, rows, empty):
    from tokenizers import Tokenizer
    import public_tokenizers
    reference = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    odd = [(200 + i, t, "en", "s", 0, "k", "r") for i, t in enumerate(["  a  b", " \n x", "it's  we'll ", "<|endoftext|> a", "日本 語 😀", "q\r\n c ",
           "x<|endoftext|><|endoftext|>y <|endoftext| > <|endoftext|>", "<|endoftext|>"])]
    assert reference.encode("<|endoftext|> a", add_special_tokens=False).ids == [50256, 257]
    got = packing.pack(docs.unionByName(spark.createDataFrame(odd, DOCS)), task_chars=20_000).collect()
    places = defaultdict(list)
    for p in got:
        places[p.sequence_id].append((p.offset, p.length))
    for v in places.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= 2048
    have = Counter((p.doc_id, p.start, p.length, p.ids_crc32, p.doc_tokens) for p in got)
    for i, t, *_ in rows + odd:
        ids = reference.encode(t or "", add_special_tokens=False).ids + [1]
        data, at = b"".join(x.to_bytes(4, "little") for x in ids), 0
        while at < len(ids):
            key = next(k for k in have if k[0] == i and k[1] == at and have[k] and k[4] == len(ids) and k[3] == zlib.crc32(data[4 * at:4 * (at + k[2])]))
            have[key] -= 1
            at += key[2]
        assert at == len(ids)
    assert not +have and packing.pack(empty).count() == 0


def test_packing_mixture(spark):
    data = [(i, " ".join(words(80, i)), "big" if i % 4 else "small") for i in range(800)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(4)
    got = packing.pack(df, task_chars=80_000).collect()
    share = Counter()
    for p in got:
        share[(p.sequence_id >> 32, p.source)] += p.length
    for b in {k[0] for k in share}:
        assert abs(share[(b, "small")] / (share[(b, "small")] + share[(b, "big")]) - 0.25) < 0.12


def test_packing_does_not_follow_row_order(spark, docs, rows):
    # a task that runs again may read its rows in another order
    more = [(300 + i, " ".join(words(30 + i, 90 + i)), "en", f"s{i % 3}", 0, "k", "r") for i in range(200)]
    given = rows + more + [more[0], (None, None, "en", "s0", 0, "k", "r")]
    pieces = [Counter(map(tuple, packing.pack(spark.createDataFrame(given[::step], DOCS).repartition(n), task_chars=20_000).collect()))
              for step, n in ((1, 1), (-1, 1), (1, 5))]
    assert pieces[0] == pieces[1] == pieces[2] and len({p[5] >> 32 for p in pieces[0]}) > 3


def test_packing_targets_count_tokens(spark):
    # digits take more tokens per character than words do
    data = [(i, " ".join(words(60, i)) if i % 2 else " ".join(["people"] * 240), "digits" if i % 2 else "plain") for i in range(1200)]
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    share, total = Counter(), Counter()
    for p in packing.pack(df, targets={"digits": 0.5, "plain": 0.5}, task_chars=120_000).collect():
        share[(p.sequence_id >> 32, p.source)] += p.length
        total[p.source] += p.length
    both = sorted({b for b, s in share if s == "digits"} & {b for b, s in share if s == "plain"})
    # while both queues last
    early = [b for b in both if b < max(both)]
    of = lambda bs, s: sum(share[(b, s)] for b in bs)
    assert len(early) > 1 and abs(of(early, "digits") / (of(early, "digits") + of(early, "plain")) - 0.5) < 0.05


def test_little_of_many_tasks_is_written_to_few_files(spark, monkeypatch):
    """Tables of short rows get a file for each task that runs at once, however
    many partitions their stage has; the rows are those of many files."""
    base, passage = words(120, 21), words(70, 22)
    texts = [" ".join(words(40, 100 + i) + passage + words(30, 300 + i)) if i % 2 else " ".join(base[:i] + ["other"] + base[i:]) for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(30)
    sizes, real = defaultdict(list), common.cut

    def counted(table, name, *args, **kwargs):
        done = real(table, name, *args, **kwargs)
        sizes[name].append(len(done.inputFiles()))
        return done
    for module in (minhash, suffixes):
        monkeypatch.setattr(module, "cut", counted)
    settings = {"spark.sql.shuffle.partitions": "30", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        near = {r.class_id for r in minhash.classes(df).collect()}
        spans = {(r.doc_id, r.begin, r.end, r.first_doc_id) for r in suffixes.repeats(df).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert near == {0, *range(1, 60, 2)}
    assert {(i, 40, 110, 1) for i in range(1, 60, 2)} <= spans
    for name in ("minhash-buckets", "minhash-links", "suffix-repeated", "suffix-spans"):
        assert sizes[name] and max(sizes[name]) <= spark.sparkContext.defaultParallelism, (name, sizes[name])


def test_cut_leaves_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    tracker = spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    known = lambda: tracker.shuffleStatuses().size()
    df = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).agg(F.count("*").alias("n")).repartition(3)
    held = known()
    table = common.cut(df, "cleanup")
    assert known() <= held and spark.conf.get(key, None) == before
    assert sorted(r.n for r in table.collect()) == [100] * 10
    assert sorted(r.n for r in df.collect()) == [100] * 10   # the table's rows can still be computed again
