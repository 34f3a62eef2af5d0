"""Small cases of the findings of round 3, which the code before failed."""

import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from voxelframe import ArrayFrame
from voxelframe.llm import embedding_dedup, substring_dedup, toxicity
from voxelframe.operators import correlation, points
from voxelframe.plans import catalog


def test_angle_of_zeros_with_signs(spark, tmp_path):
    """F2: values that are rounded to -0.0, where the other difference is negative, zero or positive."""
    tiny = (-0.0003, 0.0003, 0.0, -0.0)
    vectors = [[a] * 16 + [b] * 16 + [c] * 16 + [d] * 16 for a in (-0.002, *tiny[:2], 0.002) for c in (-0.001, *tiny[:2]) for b in tiny for d in tiny]
    pq.write_table(pa.table({"vec_id": list(range(len(vectors))), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": [0] * len(vectors)}), tmp_path / "embeddings.parquet")
    got = sorted(map(tuple, catalog.QUERIES["stokes_angle"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet')")
    want = sorted(con.execute(catalog.ORACLES["stokes_angle"]).fetchall())
    assert got == want and min(r[3] for r in got) == -1.570796


def test_linking_builds_no_table_on_the_driver(spark):
    """no join of points or links is by broadcast, however small their rows pack."""
    df = spark.range(400).select((F.col("id") % 20).cast("int").alias("t"), F.rand(1).alias("y"), F.rand(2).alias("x"))
    out = points.link(df, 0.3)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    pairs = points._candidates(df.withColumn("_id", F.monotonically_increasing_id()), ["y", "x"], 0.3, 0, [])
    pairs.collect()
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_toxicity_learns_from_all_texts(spark):
    """every labelled text counts, also long ones, and shards may be dealt out in any way."""
    rows = [(i, " ".join(f"w{(i * 7 + k * (k + i)) % 97}" for k in range(30)) + (" zork" if i % 4 == 0 else ""), "en" if i % 3 else None) for i in range(400)]
    long = [(i, "plain words " * 20000 + ("blag " if i % 2 else "mild ") * 50, "en") for i in range(400, 424)]
    docs = spark.createDataFrame([*rows, *long], "doc_id bigint, text string, lang string")
    labels = docs.select("doc_id", F.expr("int(text like '%zork%' or text like '%blag%')").alias("label"))
    net = toxicity.fit(docs, labels, each=150)
    again = toxicity.fit(docs.repartition(7), labels.union(labels).repartition(3), each=150)
    assert all((a == b).all() for a, b in zip(net.params(), again.params())) and (net.thresholds == again.thresholds).all()
    scratch = toxicity.Scratch(spark, "test")
    sizes = [len(r["y"]) for r in toxicity.shards(docs, labels, 150, scratch).collect()]
    assert len(sizes) == 3 and sum(sizes) == 424
    assert net.one.any(axis=1)[[int(toxicity.rows_of(toxicity.word_hashes(next(toxicity.B.blocks(pa.array([w]))))[0])[0][0]) for w in ("blag", "zork", "plain")]].all()
    got = toxicity.predict(docs, net).join(labels, "doc_id").where("predicted = label").count()
    assert got > 0.95 * 424


def test_kernels_get_few_arrays_at_once(spark):
    """what a kernel makes of a stack does not grow with the rows of a batch."""
    df = spark.range(40).coalesce(1).select(F.col("id").alias("p"), F.expr("transform(sequence(1, 16384), i -> double(i + id))").alias("data"))
    frame = ArrayFrame(df, "p", "yx", (128, 128), "float64")
    most = frame.map(lambda x: np.full((len(x), 1, 1), float(len(x))), shape=(1, 1)).df.collect()
    assert len(most) == 40 and max(r["data"][0] for r in most) <= 8
    rows = frame.table(lambda x: {"n": [len(x)] * len(x), "first": x[:, 0, 0].tolist()}, "n int, first double").collect()
    assert sorted((r["p"], r["first"]) for r in rows) == [(i, i + 1.0) for i in range(40)] and max(r["n"] for r in rows) <= 8


def test_deviation_of_large_chunks(spark):
    """a chunk's spread takes one pass, and the arrays are made once."""
    df = spark.range(2).select(F.col("id").alias("p"), F.expr("transform(sequence(1, 65536), i -> double(1e9 + (i * 7919) % 1000 * (id + 1)))").alias("data"))
    out = ArrayFrame(df, "p", "yx", (256, 256), "float64").rechunk((250, 200)).reduce("std")
    x = 1e9 + np.arange(1, 65537) * 7919 % 1000 * np.array([[1.0], [2.0]])
    got = {r["p"]: r["value"] for r in out.collect()}
    assert np.allclose([got[0], got[1]], x.std(axis=1), rtol=1e-12)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_near_duplicates_have_one_plan(spark, monkeypatch):
    """how keys are made does not depend on the number of vectors: rows are not counted for it."""
    made = []
    monkeypatch.setattr(embedding_dedup, "Plan", lambda *a, plan=embedding_dedup.Plan: made.append(a) or plan(*a))
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.01]), (3, [0.0, 1.0])], "vec_id bigint, embedding array<double>")
    out = {r["vec_id"]: r["component_id"] for r in embedding_dedup.near_duplicates(df).collect()}
    assert out == {1: 1, 2: 1, 3: 3} and made[0][1:3] == embedding_dedup.PLACES and not hasattr(embedding_dedup, "shared_places")


def test_toxicity_shards_are_small_rows(spark):
    """pipeline: a shard is one row for the JVM, so its words are packed (six bytes each before), and come out as they were; also with over 2^16 different ones."""
    rows = [(i, " ".join(f"w{(i * 7 + k * (k + i)) % 997}" for k in range(400))) for i in range(200)]
    docs = spark.createDataFrame([*rows, (200, " ".join(f"v{k}" for k in range(70000))), (201, ""), (202, None)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    for part in (docs.where("doc_id < 200"), docs):
        out = toxicity.shards(part, labels.join(part, "doc_id", "left_semi"), 1000, toxicity.Scratch(spark, "test")).toArrow()
        (_, h, first, y, _, _), = toxicity._opened(out.to_batches())
        texts = {r["doc_id"]: r["text"] for r in part.collect()}
        want = [toxicity.word_hashes(next(toxicity.B.blocks(pa.array([texts[i] or ""]))))[0] & np.uint64(2**48 - 1) for i in sorted(texts)]
        assert (h == np.concatenate(want)).all() and np.diff(first).tolist() == [len(w) for w in want] and y.tolist() == [i % 2 for i in sorted(texts)]
        if len(texts) == 200:
            assert len(out.column("words")[0].as_buffer()) < 3 * len(h)


def test_anchors_of_many_buckets_are_few_bytes(spark):
    """op3_substring_dedup: with more buckets a document is named in more of them; names were 16 bytes each (25 an anchor here)."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 500)) for _ in range(800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800), pa.int64()), pa.array(range(10**6, 10**6 + 800), pa.int64()), pa.array(texts)], ["rid", "doc_id", "text"])
    (*_, anchor, ok, _), = (substring_dedup.edges(b, 13) for b in [substring_dedup.B.Block(*substring_dedup.B.buffers(batch.column(2)), 0)])
    n = len(np.unique(anchor[ok]))
    sent = sum(len(x) for out in substring_dedup._anchor_batches(13, 6144)(iter([batch])) for x in out.column(2).to_pylist())
    assert n > 50000 and sent < 14 * n


def test_repeats_with_ids_far_apart(spark):
    """op3_substring_dedup: ids are sent as what they are above the least; here that is beyond 32 and 63 bits."""
    w = [f"w{i}" for i in range(60)]
    ids = [-(2**63), -5, 3, 2**40, 2**63 - 1]
    df = spark.createDataFrame([(i, " ".join([f"x{i}", *w[5 * k :]])) for k, i in enumerate(ids)], "doc_id bigint, text string")
    for rows in (df.coalesce(1), df.repartition(5)):
        got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(rows).collect())
        assert got == [(i, 61 - 5 * k, 60 - 5 * k if k else 0) for k, i in enumerate(ids)]


def test_mutual_information_counts_rows_where_they_met(spark):
    """arrays of one shape are not grouped by pixels; the plan for other shapes gives the same values."""
    rng = np.random.default_rng(3)
    x, y, m = rng.normal(size=(6, 5, 7)), rng.normal(size=(6, 5, 7)), rng.random((6, 5, 7)) < 0.3
    y[0], x[1], y[1], m[2] = x[0], 4.0, 4.0, True
    x[3, 0, 0] = np.nan
    a, b, mask = (ArrayFrame.from_numpy(spark, v, "pyx", "yx") for v in (x, y, m))
    for masked in (None, mask):
        df = correlation.nmi(a, b, masked, bins=4)
        got = {r["p"]: r["value"] for r in df.collect()}
        assert "Aggregate" not in df._jdf.queryExecution().executedPlan().toString()
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(correlation, "_in_rows", lambda *_: False)
            want = {r["p"]: r["value"] for r in correlation.nmi(a, b, masked, bins=4).collect()}
        assert got.keys() == want.keys() and np.allclose([got[k] for k in want], list(want.values()), rtol=1e-12) and got[1] == 1.0


def test_toxicity_workers_hold_rows_of_their_words(spark):
    """pipeline: a worker held the learner as a closure's bytes, as made of them, and as a copy (17 MB each); now once, and a shard learns with the rows of its own words, and learns the same."""
    docs = spark.createDataFrame([(i, " ".join(f"w{(i * 7 + k * (k + i)) % 997}" for k in range(60))) for i in range(200)], "doc_id bigint, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("label"))
    batches = toxicity.shards(docs, labels, 1000, toxicity.Scratch(spark, "test")).toArrow().to_batches()
    counts = dict(zip(*(c.to_pylist() for c in next(toxicity._survey_batches(iter(batches))).columns)))
    seen = [np.unpackbits(np.frombuffer(counts[k], np.uint8), count=toxicity.SIZE + 1) > 0 for k in "01"]
    learner, options = toxicity.Learner.start(seen, 3), {"epochs": 2, "batch": 32, "rate": 0.8, "drop": 0.5}
    run = toxicity._round_batches(spark.sparkContext.broadcast(learner), 0, np.ones(2), 5, options)
    tracemalloc.start()
    out, = run(iter(batches))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(cloudpickle.dumps(run)) < 20_000 and most < 8e6
    spark.sparkContext._pickled_broadcast_vars.clear()
    (shard, h, first, y, held, _), = toxicity._opened(batches)
    whole = toxicity.Learner([np.arange(toxicity.SIZE + 1)] * 2, learner.whole(), [np.full(p.shape, 1e-2, p.dtype) for p in learner.whole().params()])
    mine = [h[first[d] : first[d + 1]] for d in np.flatnonzero(~held)]
    whole.learn(*toxicity.rows_of(np.concatenate(mine)), np.cumsum([0, *map(len, mine)]), y[~held], np.ones(2)[y[~held].astype(int)], np.random.default_rng([5, 0, shard]), **options)
    toxicity._moved(learner, {r["part"]: r["blob"] for b in [out.to_pylist()] for k in sorted({r["part"] for r in b}) for r in toxicity._round_merged((pa.scalar(k),), pa.Table.from_pylist([r for r in b if r["part"] == k])).to_pylist()})
    assert all(np.allclose(a, b, rtol=0, atol=1e-6) for a, b in zip(learner.whole().params(), whole.net.params())) and (abs(whole.net.one[:-1]) > 0).any(axis=1).sum() == seen[0].sum()
