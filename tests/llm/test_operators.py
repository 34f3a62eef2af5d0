"""Corpus operators against brute force on small corpora with awkward rows."""

import base64
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import corpus_pipeline
from pyspark.sql import functions as F

from voxelframe.llm import bytetext as B
from voxelframe.llm import components, decontamination, language_id, line_dedup, ngram_join, packing, quality_ordinal, quality_rules, substring_dedup, toxicity, warc
from voxelframe.llm.bitmaps import bitmap, hit
from voxelframe.llm.labelled import sample
from voxelframe.llm.shared import Scratch

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed: int = 0, n: int = 120) -> list[tuple]:
    """Prose with copies, near copies, shared passages and lines, and odd rows."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(400)] + ["Élan", "straße", "naïve"]

    def words(k):
        return [rng.choice(vocabulary) for _ in range(k)]

    passage = " ".join(words(60))
    texts = []
    for i in range(n):
        kind = i % 8
        body = words(rng.randint(1, 150))
        if kind == 1 and texts:
            texts.append(rng.choice(texts))
            continue
        if kind == 2 and texts and texts[-2 % len(texts)]:
            body = (texts[-2 % len(texts)] or "x").split(" ")
            body[rng.randrange(len(body))] = "changed"
        if kind == 3:
            at = rng.randint(0, len(body))
            body[at:at] = passage.split(" ")
        text = ""
        for w in body:
            text += w + rng.choice([" ", " ", " ", " ", "\n", "\t", "  ", ". "])
        texts.append(text)
    texts[5], texts[6], texts[7], texts[8] = None, "", " \n\t ", "one two"
    rows = [(i * 3 % n if n % 3 else i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), len(t or "")) for i, t in enumerate(texts)]
    rows.append((1000, "word " * 4000 + "end", "en", "a", 20003))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def split(text):
    return WORDS.findall(text or "")


# text buffers ---------------------------------------------------------------------


def test_words_and_hashes():
    column = pa.array(["a b\tc", None, "", " x ", "c é\n\x0bzz"])
    found = [b.data[s:e].tobytes().decode() for b in B.blocks(column) for s, e in zip(*b.words()[:2])]
    assert found == ["a", "b", "c", "x", "c", "é", "zz"]
    hashes = [h for b in B.blocks(column) for h in b.hashes(*b.words()[:2])]
    assert hashes[2] == hashes[4] and len(set(map(int, hashes))) == 6
    for limit in (1, 3, 100):
        assert [int(h) for b in B.blocks(column, limit) for h in b.hashes(*b.words()[:2])] == [int(h) for h in hashes]


def test_windows_do_not_depend_on_place():
    x = np.arange(50, dtype=np.uint64)
    w = B.windows(np.concatenate([x, x]), 5)
    assert (w[:46] == w[50:]).all() and len(set(map(int, w[:50]))) == 50


def test_slices_keep_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(20)), pa.array(["x" * i for i in range(20)])], ["i", "t"])
    for limit in (1, 30, 1000):
        parts = list(B.slices(iter([batch.slice(0, 7), batch.slice(7)]), 1, limit))
        assert [i for p in parts for i in p.column(0).to_pylist()] == list(range(20))


def test_bitmap(spark):
    df = spark.range(2000).select(F.xxhash64("id").alias("h"))
    h = np.array([r["h"] for r in df.collect()], np.int64).view(np.uint64)
    table = bitmap(df, bits=18)
    assert hit(table, h).all() and hit(table, B.mix(np.arange(5000, dtype=np.uint64))).mean() < 0.05


# language -------------------------------------------------------------------------


def test_language(spark, empty):
    rng = random.Random(1)
    alphabets = {"aa": "abcde ", "bb": "fghij ", "cc": "éüñ k "}
    rows = [(i, "".join(rng.choice(alphabets[l]) for _ in range(rng.randint(20, 600))), l) for i, l in enumerate(sorted(alphabets) * 60)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    net = language_id.fit(df.where("doc_id % 4 <> 2"), sample=300, epochs=6)
    odd = spark.createDataFrame([(900, None), (901, ""), (902, "123 !?"), (None, "abc")], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in language_id.predict(df.select("doc_id", "text").union(odd), net).collect()}
    held = [i for i, _, _ in rows if i % 4 == 2]
    assert np.mean([got[i]["lang_pred"] == rows[i][2] for i in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and None in got
    assert language_id.predict(empty, net).count() == 0
    none = language_id.fit(empty)
    assert {r["lang_pred"] for r in language_id.predict(df.limit(3), none).collect()} == {"und"}


# warc -----------------------------------------------------------------------------


def test_warc_round_trip(spark):
    rows = [(i, f"http://x/{i}", f"<p>{i % 4}</p>" * (i % 5)) for i in range(40)] + [(40, None, None), (41, "http://a\r\nb", ""), (None, "u", "only"), (50, "v", "é" * 3000), (0, "again", "")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)
    got = warc.round_trip(df.withColumn("revisit", F.lit(1)), roll=2000).collect()
    assert len(got) == len(rows)
    lead = {}
    for i, _, h in rows:
        if i is not None:
            lead[h or ""] = min(i, lead.get(h or "", i))
    want = Counter()
    for i, _, h in rows:
        p = (h or "").encode()
        first = lead.get(h or "")
        again = first is not None and i != first
        want[(i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first if again else None)] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.round_trip(df.limit(0)).count() == 0


def test_warc_members(tmp_path):
    raw = [warc.record(i, "http://x", b"a\r\n\r\nWARC/1.1" * i) for i in range(5)]
    whole = zlib.compressobj(6, zlib.DEFLATED, 31)
    (tmp_path / "a.gz").write_bytes(whole.compress(b"".join(raw)) + whole.flush())
    with open(tmp_path / "a.gz", "rb") as source, open(tmp_path / "b.gz", "wb") as out:
        index = list(warc.rewrite(source, out))
    data = (tmp_path / "b.gz").read_bytes()
    assert [zlib.decompress(data[e["offset"] : e["offset"] + e["length"]], 31) for e in index] == raw
    with pytest.raises(ValueError):
        list(warc.records(iter([raw[1][:-9]])))


# repeats --------------------------------------------------------------------------


def brute_repeats(texts, span):
    first, out = {}, {}
    for i, t in sorted(texts.items()):
        w = split(t)
        covered = [False] * len(w)
        for k in range(len(w) - span + 1):
            if first.setdefault(tuple(w[k : k + span]), i) < i:
                covered[k : k + span] = [True] * span
        kept = [a for a, c in zip(w, covered) if not c]
        out[i] = (len(w), len(w) - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())
    return out


def test_substring_dedup(docs, empty):
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(docs).collect()}
    want = brute_repeats(texts_of(docs), 13)
    assert got == want and sum(n for _, n, _ in want.values()) > 500
    texts = texts_of(docs)
    paths = substring_dedup.repeated_paths(docs).collect()
    for p in paths:
        a, b = split(texts[p["doc_id"]]), split(texts[p["source_id"]])
        assert p["source_id"] < p["doc_id"] and a[p["place"] : p["place"] + p["n_words"]] == b[p["source_place"] : p["source_place"] + p["n_words"]]
    assert max(p["n_words"] for p in paths) >= 60
    # maximal: no path goes on where another of the same row and source ends
    ends = {(p["doc_id"], p["source_id"], p["place"] + p["n_words"] - 12, p["source_place"] - p["place"]) for p in paths}
    assert not ends & {(p["doc_id"], p["source_id"], p["place"], p["source_place"] - p["place"]) for p in paths}
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_substring_pieces_need_the_joins(spark):
    """What buckets find is shorter than the paths: without the compaction no piece is as long as a copy."""
    rng = random.Random(47)
    w = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    df = spark.createDataFrame([(1, " ".join(w)), (2, "before it " + " ".join(w) + " behind")], "doc_id bigint, text string").repartition(2, "doc_id")
    rows, pieces = substring_dedup._repeats(df, 13, Scratch(spark, "t"))
    tasks = df.select(F.spark_partition_id()).distinct().count()
    assert sum(r["edges"] for r in pieces.collect()) == 288 and (tasks == 1 or pieces.count() > 20)
    path = substring_dedup.repeated_paths(df).collect()
    assert [tuple(p) for p in path] == [(2, 2, 1, 0, 300)]


def test_substring_words_are_compared(spark, monkeypatch):
    """Where hashes of different words agree, the words of source and copy decide."""
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    df = spark.createDataFrame([(1, a), (2, b)], "doc_id bigint, text string")
    rows = df.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    rid = rows.where("doc_id = 2").first()["rid"]
    false = spark.createDataFrame([(rid, 0, 1, 0, 20)], "rid bigint, place bigint, source_id bigint, source_place bigint, n_words bigint")
    told = substring_dedup._with_digests(false, rows, Scratch(spark, "t")).groupBy("rid").agg(F.collect_list(F.struct("place", "source_id", "source_place", "n_words", "digests")).alias("paths"))
    found = rows.join(told, "rid").select("doc_id", "text", "paths").mapInArrow(substring_dedup._agreeing_batches, "doc_id bigint, place bigint, source_id bigint, source_place bigint, n_words bigint")
    assert told.count() == 1 and found.count() == 0


def test_substring_null_and_equal_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(None, t), (1, t), (1, t), (2, t)], "doc_id bigint, text string")
    got = sorted(((r["doc_id"] or 0), r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 30)]
    # rows that share a doc_id but not the text, in one task, with their source in another
    u, v, w = (" ".join(f"{c}{i}" for i in range(30)) for c in "uvw")
    df = spark.createDataFrame([(1, f"{u} {v} {w}")], "doc_id bigint, text string").union(spark.createDataFrame([(2, f"x {u}"), (2, f"y {u} {v}"), (2, f"z {w}")], "doc_id bigint, text string").coalesce(1))
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(df).collect())
    assert got == [(1, 90, 0), (2, 31, 30), (2, 31, 30), (2, 61, 60)]
    # equal rows in different tasks whose pieces are cut differently
    pieces = [(0, 50), (0, 3), (3, 97), (20, 5)]
    cut = spark.createDataFrame([(7, p, 1, p + 10, n) for p, n in pieces], ", ".join(f"{c} bigint" for c in substring_dedup.PIECE))
    assert sorted((r["place"], r["source_place"], r["n_words"]) for r in substring_dedup._compacted(cut, 13).collect()) == [(0, 10, 37), (0, 10, 62), (20, 30, 92)]




# joins ----------------------------------------------------------------------------


def brute_groups(texts, n, percent):
    sets = {}
    for i, t in texts.items():
        w = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in split(t)]
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_ngram_join(docs, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(docs).collect()}
    want = brute_groups(texts_of(docs), 5, 80)
    assert got == want and sum(c != i for i, (_, c) in want.items()) > 10
    assert ngram_join.similar_groups(empty).count() == 0


def test_ngram_join_large_near_group(spark, monkeypatch):
    """A chain of near copies around the threshold, more sets than are tried in a turn."""
    monkeypatch.setattr(ngram_join, "LEADERS_TESTED", 3)
    rng = random.Random(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df).collect()}
    assert got == brute_groups(dict(rows), 5, 80)


def test_ngram_join_leaders_out_of_reach(spark):
    """The one similar pair meets only under n-grams with many other sets, whose pairs are all filtered by position."""
    rng = random.Random(23)
    base = [f"b{i}" for i in range(1000)]
    rows = []
    for i in range(198):
        rows.append((i, rng.sample(base, 870) + [f"o{i}x{j}" for j in range(130)]))
    rows += [(500, base[50:] + [f"fu{j}" for j in range(50)]), (501, base[:50] + base[100:] + [f"fv{j}" for j in range(50)])]
    df = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id bigint, text string").repartition(4)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, n=1).collect()}
    want = brute_groups({i: " ".join(w) for i, w in rows}, 1, 80)
    assert got == want and want[501] == (1000, 500)


def test_ngram_join_equal_ids(spark):
    """Rows that repeat a doc_id, with the same text or with another one."""
    w = [f"w{i}" for i in range(400)]
    half = w[:200] + [f"z{i}" for i in range(200)]
    near = [*w[:390], *[f"y{i}" for i in range(10)]]
    rows = [(1, w), (1, w), (2, half), (2, half), (3, near), (3, [f"q{i}" for i in range(300)]), (4, [f"q{i}" for i in range(295)])]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id bigint, text string").repartition(3)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.similar_groups(df, n=1, percent=80).collect())
    assert got == Counter({(1, 400, 1): 2, (2, 400, 2): 2, (3, 400, 1): 1, (3, 300, 3): 1, (4, 295, 3): 1})
    pairs = spark.createDataFrame([sorted(zip(ngram_join._batch_sets(pa.array([" ".join(w), " ".join(half)]), 1)[2].view(np.int64).tolist(), (400, 400)))], "x struct<a: bigint, na: bigint>, y struct<b: bigint, nb: bigint>").select("x.*", "y.*")
    profile = df.mapInArrow(ngram_join._profile_batches(1), "kind int, doc_id bigint, n bigint, sid bigint, bits binary").where("kind = 0")
    grams = ngram_join.Order(np.zeros(0, np.uint64), np.zeros(0, np.int64))
    assert [r["overlap"] for r in ngram_join.overlaps(df, profile, pairs, 1, grams, Scratch(spark, "t"), "o").collect()] == [200]


def test_ngram_join_signatures():
    """No more bits differ than n-grams, at any two widths; sets under the threshold mostly show it."""
    rng = np.random.default_rng(31)
    for n, m, both in ((300, 300, 270), (300, 300, 220), (500, 530, 480), (1000, 1100, 1000), (5000, 5000, 4200)):
        h = rng.integers(0, 2**63, n + m - both, dtype=np.uint64)
        x, y = ngram_join.signature(np.concatenate([h[:n], h[n - both :]]), np.array([0, n, n + m]))
        differ = int(ngram_join.differing(pa.array([x]), pa.array([y]))[0])
        assert differ <= n + m - 2 * both and differ % 2 == (n + m) % 2 and differ >= 0.7 * (n + m - 2 * both)


def test_ngram_join_one_order():
    """Fragments are consecutive parts of the order that prefixes are taken from."""
    rng = np.random.default_rng(37)
    h = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    grams = ngram_join.Order(h[:500], np.arange(500, dtype=np.int64) % 7 + 2)
    often = grams.often(h)
    assert (often[:500] > 0).all() and not often[500:].any()
    fragment = grams.fragment(h, often)[np.lexsort((h, often))]
    assert (np.diff(fragment) >= 0).all() and set(fragment) == set(range(ngram_join.FRAGMENTS))


@pytest.mark.parametrize("small", [0, components.SMALL])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL", small)
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(50, 80)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    root = {}

    def find(a):
        while root.setdefault(a, a) != a:
            a = root[a]
        return a

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint"), Scratch(spark, "t")).collect()}
    loops = {a for a, b in edges if a == b and sum(a in e for e in edges) == 1}
    assert got == {a: find(a) for e in edges for a in e if a not in loops}


# lines ----------------------------------------------------------------------------


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + 1 :] == b[k + 1 :] or a[k:] == b[k + 1 :] or a[k + 1 :] == b[k:]


def brute_lines(texts, least):
    seen, out = [], {}
    for i, t in sorted(texts.items()):
        if t is None:
            out[i] = None
            continue
        kept = []
        for line in t.split("\n"):
            if not (split(line) and (line in seen or len(line) >= least and any(len(s) >= least and one_edit(line, s) for s in seen))):
                kept.append(line)
            seen.append(line)
        out[i] = "\n".join(kept)
    return out


def test_line_dedup(spark):
    rng = random.Random(7)
    lines = ["".join(rng.choice("abcé ") for _ in range(rng.choice([5, 23, 24, 31, 32, 33, 47, 48, 49, 64, 65]))) for _ in range(40)]
    rows = []
    for i in range(60):
        part = []
        for _ in range(rng.randint(0, 6)):
            line = rng.choice(lines)
            how, at = rng.randrange(5), rng.randrange(len(line))
            line = {0: line, 1: line[:at] + line[at + 1 :], 2: line[:at] + "Z" + line[at:], 3: line[:at] + "Y" + line[at + 1 :], 4: line[:at] + "QQ" + line[at:]}[how]
            part.append(line)
        rows.append((i, "\n".join(part) if i != 9 else None, "en"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, places string").repartition(3)
    result = line_dedup.line_dedup(df)
    got = {r["doc_id"]: r["text"] for r in result.collect()}
    assert got == brute_lines({i: t for i, t, _ in rows}, line_dedup.MIN_CHARS)
    assert set(df.columns) < set(result.columns) and result.where("places = 'en'").count() == 60


def test_line_dedup_odd_rows(spark, empty):
    long = "a line that is long enough to count"
    df = spark.createDataFrame([(None, long), (1, long), (1, long), (2, long + "\n\n" + long)], "doc_id bigint, text string")
    got = sorted((r["doc_id"] or 0, r["text"]) for r in line_dedup.line_dedup(df).collect())
    assert got == [(0, long), (1, long), (1, long), (2, "")]
    assert line_dedup.line_dedup(empty).count() == 0
    clash = df.select("doc_id", F.lit(1).alias("gone"), "text", F.lit(2).alias("of"), F.lit(3).alias("_0"), F.lit(4).alias("n_removed_lines"), F.lit(5).alias("h"), F.lit(6).alias("n_chars"))
    for name, own in (("n_removed_lines", "_n_removed_lines"), ("N_REMOVED_LINES", "_n_removed_lines")):
        counted = line_dedup.line_dedup(clash.withColumnRenamed("n_removed_lines", name))
        assert counted.columns == [*(name if c == "n_removed_lines" else c for c in clash.columns), own]
        assert sorted((r["doc_id"] or 0, r[5], r[own]) for r in counted.collect()) == [(0, 4, 0), (1, 4, 0), (1, 4, 0), (2, 4, 2)]
    out = line_dedup.line_dedup(clash, counted=None)
    assert out.columns == clash.columns and {tuple(r)[3:7] for r in out.collect()} == {(2, 3, 4, 5)}
    assert sorted((r["doc_id"] or 0, r["text"], r["n_chars"]) for r in out.collect()) == [(0, long, 6), (1, long, 6), (1, long, 6), (2, "", 0)]


def test_line_dedup_long_text(spark):
    """A document of many lines, nearly all of which go, and very long lines."""
    head = "\n".join(f"line number {i} of a long text" for i in range(3000))
    df = spark.createDataFrame([(1, head), (2, head + "\nand one of its own, long enough"), (3, "x" * 40_000), (4, "x" * 39_999)], "doc_id bigint, text string")
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(df).collect()}
    assert got[2] == "and one of its own, long enough" and got[3] == "x" * 40_000 and got[4] == "" and got[1].startswith("line number 0 of")


def test_line_dedup_long_lines(spark, monkeypatch):
    """Lines around the lengths from which variants are made by block, and around the ends of blocks."""
    monkeypatch.setattr(line_dedup, "LONG", 40)
    monkeypatch.setattr(line_dedup, "BLOCK", 8)
    rng = random.Random(41)
    lines = ["".join(rng.choice("abé") for _ in range(n)) for n in (39, 40, 41, 42, 47, 48, 49, 55, 56, 57, 64, 65, 71)]
    rows = []
    for i in range(150):
        line = rng.choice(lines)
        at = rng.choice([0, len(line) - 1, rng.randrange(len(line))])
        rows.append((i, rng.choice([line, line[:at] + line[at + 1 :], line[:at] + "Z" + line[at:], line[:at] + "Y" + line[at + 1 :], line[:at] + "QQ" + line[at:], line + "e"])))
    got = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
    want = brute_lines(dict(rows), line_dedup.MIN_CHARS)
    assert got == want and 20 < sum(t != "" for t in want.values()) < 120


def test_line_dedup_short_lines(spark):
    """Exact repeats of any line with something in it go; one edit counts from the floor on."""
    rng = random.Random(29)
    lines = ["".join(rng.choice("abcé ") for _ in range(n)) for n in (1, 3, 7, 8, 9, 12, 13, 14, 15, 16, 17, 23, 24, 31, 32) for _ in range(3)] + ["", "  ", "\t"]
    for least, dedup in ((8, lambda df: line_dedup.line_dedup(df, 8)), (corpus_pipeline.NEAR_CHARS, lambda df: corpus_pipeline.distinct_lines(spark, df, ""))):
        rows = []
        for i in range(80):
            part = []
            for _ in range(rng.randint(0, 6)):
                line = rng.choice(lines)
                how, at = rng.randrange(5), rng.randrange(len(line) + 1)
                part.append({0: line, 1: line[:at] + line[at + 1 :], 2: line[:at] + "Z" + line[at:], 3: line[:at] + "Y" + line[at + 1 :], 4: line}[how])
            rows.append((i, "\n".join(part)))
        want = brute_lines(dict(rows), least)
        got = {r["doc_id"]: r["text"] for r in dedup(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()}
        assert got == want


# benchmark ------------------------------------------------------------------------


def test_decontamination(spark, docs, empty):
    items = [
        (1, "Train 7 leaves at 9 am and runs 120 km before it meets Anna at the old bridge near the harbour for 15 minutes while the other passengers wait for the ferry"),
        (2, "The quiet library closes early on sundays because nobody wants to read about the history of rivers and canals in winter"),
        (3, "short question here now"),
        (4, None),
    ]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    asked = items[0][1].replace("7", "12").replace("9 am", "4 am").replace("120 km", "88 miles").replace("Anna", "Peter").replace("15", "30")
    mixed = items[0][1].replace("9 am", "9 am")
    rows = [
        (5000, "filler words come first. " + items[1][1] + " and more words follow after it"),
        (5001, "some words before it " + asked + " and some words behind"),
        (5002, "WORDS BEFORE " + items[1][1].upper() + " WORDS BEHIND"),
        (5003, "short question here now"),
        (5004, "the quiet library closes late on mondays because everybody wants to swim"),
        (5005, mixed),
    ]
    more = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontamination(docs.select("doc_id", "text").union(more), bench).collect()}
    assert {k: v for k, v in got.items() if v} == {5000: [2], 5001: [1], 5002: [2], 5003: [3], 5005: [1]}
    assert len(got) == docs.select("doc_id").distinct().count() + len(rows)
    assert decontamination.decontamination(empty, bench).count() == 0
    assert decontamination.decontamination(more, bench.limit(0)).where("contaminated").count() == 0


def test_decontamination_by_occurrence(spark):
    """A verbatim copy beside variants of it, variants of one template, and items of one template."""
    ask = "Train {} leaves the old station at {} and runs for {} hours before it reaches the harbour where {} passengers wait for the ferry"
    item, other = ask.format(7, 9, 3, 250), ask.format(11, 6, 5, 410)
    bench = spark.createDataFrame([(1, item), (2, other), (3, "every one of these plain words stands here without any value behind it at all")], "item_id bigint, text string")
    variants = [ask.format(20 + i, 30 + i, 40 + i, 500 + i) for i in range(9)]
    rows = [
        (1, item + ". " + variants[0]),
        (2, "first some words. " + ". ".join(variants) + " and a tail"),
        (3, item + "\n" + other),
        (4, variants[1].replace("hours", "long hours") + ". " + variants[2]),
        (5, "the train leaves the old station and nobody reaches the harbour"),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: [1, 2], 2: [1, 2], 3: [1, 2], 4: [1, 2], 5: []}


def test_decontamination_dense_items(spark):
    """Windows that are mostly placeholders are found by their values; they take nothing from what the others find."""
    dense = "12 + 7 = 19 and 5 + 6 = 11"
    mixed = "the small shop near the river sells bread and counts 4 8 15 16 23 42 51 62 73 84 95 106 117 128 139 150 161 172 183 194 205 216 227 238"
    bench = spark.createDataFrame([(1, dense), (2, mixed)], "item_id bigint, text string")
    rows = [
        (1, "we read that " + dense + " in a book"),
        (2, "we read that 13 + 8 = 21 and 4 + 5 = 9 in a book"),
        (3, re.sub(r"\d+", lambda m: str(int(m[0]) + 1000), mixed)),
        (4, "numbers 15 16 23 42 51 62 73 84 95 106 117 128 139 150 161 172 183 194 205 216"),
    ]
    got = {r["doc_id"]: r["item_ids"] for r in decontamination.decontamination(spark.createDataFrame(rows, "doc_id bigint, text string"), bench).collect()}
    assert got == {1: [1], 2: [], 3: [2], 4: [2]}


def test_canonical_tokens():
    b = next(B.blocks(pa.array(["He met Anna Smith. Then 12 kg of tea, 3 Miles"])))
    _, kind, _, _ = decontamination.canonical(b)
    W, N, A, U = decontamination.WORD, decontamination.NUMBER, decontamination.NAME, decontamination.UNIT
    assert kind.tolist() == [W, W, A, W, N, U, W, W, N, A]


# packing --------------------------------------------------------------------------


def test_packing(docs, empty):
    rows = packing.best_fit_packing(docs, capacity=256).collect()
    encode, texts = packing.encoder(), texts_of(docs)
    assert {r["doc_id"] for r in rows} == set(texts)
    bins = {}
    for r in rows:
        ids = np.append(encode(texts[r["doc_id"]] or ""), np.uint32(0)).astype("<u4")
        assert zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, t in texts.items():
        own = sorted((r["piece"], r["start"], r["length"]) for r in rows if r["doc_id"] == d)
        assert [p for p, _, _ in own] == list(range(len(own))) and all(n == 256 for _, _, n in own[1:])
        assert sum(n for _, _, n in own) == len(encode(t or "")) + 1
    for parts in bins.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(bins) <= 1.05 * -(-total // 256) + 1
    assert packing.best_fit_packing(empty).count() == 0


def test_token_ids():
    import public_tokenizers
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    plain, encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder()

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=80))
    def same(text):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids

    same()
    for text in ("a<|endoftext|>b", " " * 3000 + "x", "ab" * 2000):
        assert encode(text).tolist() == plain.encode(text, add_special_tokens=False).ids


def test_plan_uses_every_piece_once():
    rng = random.Random(11)
    for _ in range(60):
        counts = Counter(min(100, max(1, int(rng.lognormvariate(rng.choice([1, 2.5, 4]), 0.8)))) for _ in range(rng.randint(0, 300)))
        ranks, fill = {n: set() for n in counts}, Counter()
        for length, first, bins, each, sequence, at in packing.plan(dict(counts), 100):
            for q in range(bins):
                for j in range(each):
                    assert first + q * each + j not in ranks[length]
                    ranks[length].add(first + q * each + j)
                    assert fill[sequence + q] == at + j * length
                    fill[sequence + q] += length
        assert all(ranks[n] == set(range(k)) for n, k in counts.items()) and max(fill.values(), default=0) <= 100


# learned scores -------------------------------------------------------------------


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(13)
    plain = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(300)]
    rude = ["zork", "blag", "vrum"]
    docs, labels = [], []
    for i in range(900):
        w = [rng.choice(plain) for _ in range(rng.randint(5, 80))]
        toxic, junk = i % 5 == 0, i % 6 == 0
        if toxic:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(rude).capitalize() + ",")
        if junk:
            w = [x + "!!" for x in w]
        docs.append((i, " ".join(w), "en" if i % 2 else "de"))
        labels.append((i, int(toxic), int(not junk) * (2 - int(toxic))))
    return spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(4), spark.createDataFrame(labels, "doc_id bigint, toxic int, grade int"), labels


def test_toxicity(spark, labelled, empty):
    docs, labels, truth = labelled
    net = toxicity.fit(docs, labels.where("doc_id % 7 <> 0").select("doc_id", F.col("toxic").alias("label")))
    got = {r["doc_id"]: r for r in toxicity.predict(docs, net).collect()}
    held = [t for t in truth if t[0] % 7 == 0]
    assert np.mean([got[i]["predicted"] == t for i, t, _ in held]) > 0.95
    assert all(r["predicted"] == int(r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got.values())
    odd = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "zork " * 5000)], "doc_id bigint, text string")
    out = toxicity.predict(odd, net).collect()
    assert len(out) == 4 and {r["score"] for r in out if r["doc_id"] == 2} == {r["score"] for r in out if r["doc_id"] == 1}
    kept = toxicity.keep_clean(docs, net)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert toxicity.predict(empty, net).count() == 0
    assert {r["score"] for r in toxicity.predict(docs.limit(2), toxicity.fit(docs, labels.limit(0).select("doc_id", F.col("toxic").alias("label")))).collect()} == {0.0}


def test_quality(spark, labelled, empty):
    docs, labels, truth = labelled
    model = quality_ordinal.fit(docs, labels.where("doc_id % 7 <> 0").select("doc_id", F.col("grade").alias("label")))
    assert model.grades == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r["doc_id"]: r for r in quality_ordinal.predict(docs, model, 1).collect()}
    held = [t for t in truth if t[0] % 7 == 0]
    assert np.mean([(got[i]["tail_probability"] >= 0.5) == (g >= 1) for i, _, g in held]) > 0.95
    mean = {g: np.mean([got[i]["expected_grade"] for i, _, k in held if k == g]) for g in (0, 2)}
    assert mean[0] < 0.7 < 1.3 < mean[2]
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string")
    assert [(r["expected_grade"], r["tail_probability"]) for r in quality_ordinal.predict(odd, model, 1).collect()] == [(0.0, 0.0)] * 2
    assert quality_ordinal.predict(empty, model, 1).count() == 0


# rules ----------------------------------------------------------------------------


def brute_statistics(text):
    w = split(text)
    tri = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {p for k in range(len(w) - 2) if tri[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if split(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered)


def test_statistics(spark, docs):
    more = spark.createDataFrame([(2000, "a b c a b c\nx\nx\n \n \n#$ é<", "en", "a", 0), (2001, "q q q q", None, None, None)], SCHEMA)
    every = docs.union(more)
    got = {r["doc_id"]: tuple(r[c] for c in quality_rules.STATS) for r in quality_rules.text_statistics(every).collect()}
    assert got == {i: brute_statistics(t) for i, t in texts_of(every).items()}


def test_quality_rules(spark, empty):
    rng = np.random.default_rng(17)
    rows = []
    for i in range(400):
        junk = i % 20 == 0
        w = ["".join(rng.choice(list("abcdef"), rng.integers(2, 8))) + ("%%%" if junk else "") for _ in range(rng.integers(60, 300))]
        rows.append((i, " ".join(w), "en", "s" if i % 2 else None, 0))
    rows += [(900, "too short", "en", "s", 0), (901, "same words here " * 40, "en", "s", 0), (902, None, "en", "s", 0)]
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i]["base_failed"] and not got[i]["kept"] for i in (900, 901, 902))
    assert all(got[i]["kept"] == (i % 20 != 0) for i in range(400))
    assert quality_rules.quality_rules(empty).count() == 0


def test_quality_rules_small_groups(spark):
    """Groups too small for an estimate are judged by their language, or by all rows."""
    rng = np.random.default_rng(19)
    rows, junk = [], set()

    def add(lang, source, bad):
        w = ["".join(rng.choice(list("abcdef"), rng.integers(2, 8))) + ("%%%" if bad else "") for _ in range(rng.integers(60, 300))]
        junk.update([len(rows)] if bad else [])
        rows.append((len(rows), " ".join(w), lang, source, 0))

    for i in range(120):
        add("en", "large", False)
    for i in range(30):
        add("en", f"tail{i // 3}", i % 6 == 0)
    for i in range(8):
        add("de", None, i == 5)
    add(None, "alone", True)
    got = {r["doc_id"]: r for r in quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
    assert len(got) == len(rows) and all(r["distance2"] is not None for r in got.values())
    assert {i for i, r in got.items() if not r["kept"]} == junk
    few = quality_rules.quality_rules(spark.createDataFrame(rows[:4], SCHEMA)).collect()
    assert [r["kept"] and r["distance2"] is not None for r in few] == [True] * 4


def test_least_determinant(spark):
    """Small groups against the determinants of all subsets of h rows."""
    import itertools

    rng = np.random.default_rng(43)
    features = {"a": ("word_chars / 1e3", 0.01), "b": ("n_symbols / 1e3", 0.01)}
    rows, points = [], {}
    for g in ("u", "v", "w"):
        x = rng.normal(0, 1, (12, 2)) * [1, 0.2]
        x[rng.permutation(12)[:3]] += 6 if g == "u" else -4
        x = np.round(x + 20, 3)
        points[g] = x
        rows += [(len(rows) + i, g, None, 100, int(round(a * 1e3)), int(round(b * 1e3)), 0, 0) for i, (a, b) in enumerate(x)]
    stats = spark.createDataFrame(rows, quality_rules._SCHEMA).repartition(3)
    got = quality_rules.robust_outliers(stats, h=0.75, starts=6, min_group=5, features=features).collect()
    for g, x in points.items():
        det = lambda at: np.linalg.slogdet(np.cov(x[list(at)].T, bias=True) + 0.01**2 * np.eye(2))[1]
        least = min(det(at) for at in itertools.combinations(range(12), 9))
        mine = {r["doc_id"]: r for r in got if r["g"] == f'{{"lang":"{g}"}}'}
        assert len(mine) == 12 and next(iter(mine.values()))["logdet"] == pytest.approx(least, abs=0.05)
        far = sorted(mine, key=lambda i: -mine[i]["d2"])[:3]
        best = min(itertools.combinations(range(12), 9), key=det)
        assert {i - min(mine) for i in far} == set(range(12)) - set(best)


def test_quality_rules_odd_rows(spark):
    """Columns with clashing names, repeated rows, null ids."""
    text = " ".join(f"word{i} and" for i in range(60))
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (2, "")], "doc_id bigint, text string")
    df = df.select("doc_id", F.lit("en").alias("lang"), F.lit("a").alias("source"), "text", F.lit(1).alias("g"), F.lit(2).alias("use"), F.lit(3).alias("length"), F.lit(4).alias("n_words"))
    got = sorted((r["doc_id"] or 0, r["base_failed"], r["kept"]) for r in quality_rules.quality_rules(df).collect())
    assert got == [(0, False, True), (1, False, True), (1, False, True), (2, True, False)]


def test_sample_is_bounded(spark):
    """A doc_id that repeats, with labels that repeat, brings no more rows to the driver than asked for."""
    many = spark.range(3000).select(F.lit(1).cast("bigint").alias("doc_id"), F.concat(F.lit("some words "), "id").alias("text"), F.lit("en").alias("lang"))
    labels = spark.createDataFrame([(1, 1)] * 50 + [(1, 0), (2, 0), (None, 1), (3, None)], "doc_id bigint, label int")
    h, first, y, lang, weight = sample(many, labels, toxicity.word_hashes, 10, 1000)
    assert len(y) == 10 == len(first) - 1 == len(weight) and set(y) <= {0, 1} and set(lang) == {"en"}
    one = many.limit(1).union(spark.createDataFrame([(2, "clean text", "de")], many.schema))
    _, _, y, lang, _ = sample(one, labels, toxicity.word_hashes, 10, 1000)
    assert sorted(zip(y, lang)) == [(0, "de"), (0, "en"), (1, "en")]
