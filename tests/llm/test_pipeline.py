import os
import random
import sys

import pytest

import corpus_pipeline
from voxelframe.llm.queries import ORACLES, QUERIES

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import brute_groups, brute_lines  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def test_stages(spark, tmp_path):
    """Each stage on what the one before kept: columns stay, rows only go, decisions hold."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    names, before = [], docs
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        names.append(name)
        after = stage(spark, before, DATA)
        after.write.parquet(f"{tmp_path}/{i}")
        after = spark.read.parquet(f"{tmp_path}/{i}")
        if i < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns and after.join(before, "doc_id", "left_anti").count() == 0
            before = after
    assert names == ["toxicity", "line_dedup", "ngram_jaccard", "decontamination", "packing"]
    assert {r["doc_id"] for r in after.select("doc_id").collect()} == {r["doc_id"] for r in before.select("doc_id").collect()}
    assert 0.6 * docs.count() < before.count() < docs.count()


def test_whole_run(spark):
    rows = corpus_pipeline.run(spark, DATA)
    assert rows.groupBy("sequence_id").agg({"length": "sum"}).where("`sum(length)` > 2048").count() == 0


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, gone string, _0 string, h string"


def odd_rows():
    """Toxic texts, copies, near copies, repeated lines, benchmark passages, and rows with nothing in them."""
    rng = random.Random(53)
    w = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrst"]

    def prose(k):
        return "\n".join(" ".join(rng.choice(w) for _ in range(12)) for _ in range(k))

    texts = [prose(rng.randint(2, 6)) for _ in range(60)]
    for i in range(0, 60, 6):
        texts[i + 1] = texts[i]  # a copy
        near = texts[i].split(" ")
        near[len(near) // 2] = "changed"
        texts[i + 2] = " ".join(near)
        texts[i + 3] += "\n" + texts[i + 4].split("\n")[0]
        texts[i + 5] += "\nzork blag vrum zork"
    texts[7], texts[8], texts[9] = None, "", " \n "
    return [(i, t, "en", "s", len(t or ""), "x", "y", "z") for i, t in enumerate(texts)]


def lines_of(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_stages_by_brute_force(spark, tmp_path):
    """What each stage keeps of its own input, on rows with clashing names, nulls and copies."""
    rows = odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    rng = random.Random(59)
    learn = [(10_000 + i, ("zork " if i % 3 == 0 else "") + " ".join(rng.choice("bal del fil gom kus".split()) for _ in range(20)) + (" vrum blag" if i % 3 == 0 else ""), int(i % 3 == 0)) for i in range(300)]
    more = spark.createDataFrame([(i, t, "en", "s", len(t), "", "", "") for i, t, _ in learn], SCHEMA)
    spark.createDataFrame([(i, 1, y) for i, _, y in learn], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    item = " ".join(rows[12][1].split()[:24])
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    def step(k, df):
        out = corpus_pipeline.STAGES[k][1](spark, df, str(tmp_path))
        assert out.columns == df.columns
        return spark.createDataFrame(out.collect(), df.schema)

    clean = step(0, docs.union(more))
    toxic = {i for i, t, *_ in rows if t and "zork" in t}
    assert {r["doc_id"] for r in clean.collect() if r["doc_id"] < 1000} == {r[0] for r in rows} - toxic
    clean = clean.where("doc_id < 1000")

    before, thin = lines_of(clean.collect()), step(1, clean)
    assert lines_of(thin.collect()) == brute_lines(before, corpus_pipeline.NEAR_CHARS)
    assert all(r["n_chars"] == len(r["text"] or "") and r["gone"] == "x" for r in thin.collect())

    groups = brute_groups(before, 5, 80)
    one = step(2, clean)
    assert lines_of(one.collect()) == {i: t for i, t in before.items() if groups[i][1] == i} and len(groups) > one.count()

    rest = {r["doc_id"] for r in step(3, one).collect()}
    words = item.split()
    holds = {i for i, t in lines_of(one.collect()).items() if any(" ".join(words[k : k + 8]) in " ".join((t or "").split()) for k in range(len(words) - 7))}
    assert rest == set(lines_of(one.collect())) - holds and holds

    packed = corpus_pipeline.STAGES[4][1](spark, one, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in one.collect()}
    for k in range(4):
        assert step(k, docs.limit(0)).count() == 0
    assert corpus_pipeline.STAGES[4][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_registered():
    import __spark_entry__

    found = __spark_entry__.queries()
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(found) and set(ORACLES) <= set(__spark_entry__.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    cur = con.execute(ORACLES[name])
    cols = [d[0] for d in cur.description]
    df = QUERIES[name](spark, DATA)
    assert sorted(df.columns) == sorted(cols)
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == sorted(cur.fetchall(), key=str)
