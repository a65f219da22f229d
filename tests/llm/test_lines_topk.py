import hashlib

import duckdb
import numpy as np
from pyspark.sql import functions as F

from cellwave.llm import linededup, topk


def sql_rows(docs):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    return {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, n_lines, removed_lines, removed_chunks, kept_sha256 FROM ({linededup.OP8_SQL})").fetchall()}


def line_rows(df):
    return {r["doc_id"]: (r["n_lines"], r["removed_lines"], r["removed_chunks"], hashlib.sha256((r["kept_text"] or "").encode()).hexdigest()) for r in df.collect()}


def test_line_dedup_is_its_sql(spark, docs_frame):
    block = "\n".join(f"line {i}" for i in range(60))
    rows = [(i, f"head {i}\n{block}\ntail {i}\n\n") for i in range(20)] + [(30, block), (31, block), (32, None), (33, ""), (34, "\n\n\n\n\n\n"), (35, "one"), (36, "one"), (37, "é\r\nx\n" * 3000), (38, "a\na\na\nb"), (39, "a\na\na\nc")]
    made = linededup.dedup_lines(docs_frame(rows)).cache()
    assert line_rows(made) == sql_rows(rows)
    got = {r["doc_id"]: r for r in made.collect()}
    # a line put in before them moves the boundaries of a few chunks at most
    assert sum(got[i]["removed_lines"] for i in range(1, 20)) > 19 * 50
    assert got[0]["removed_lines"] == 0 and got[32]["kept_text"] is None and got[33]["kept_text"] == "" and got[35]["kept_text"] == "one"
    for i in (0, 35):
        assert got[i]["kept_text"] == dict(rows)[i]


def test_line_dedup_edge_rows(spark, docs_frame):
    text = "a\nb\nc\nd\ne\nf\ng"
    twice = linededup.dedup_lines(docs_frame([(1, text), (1, text), (None, text)]), keep=["doc_id", "lang", "key", "_text"]).collect()
    assert len(twice) == 3 and {r["kept_text"] for r in twice if r["doc_id"] is None} == {text}
    assert len({r["kept_text"] for r in twice if r["doc_id"] == 1}) == 1
    assert linededup.dedup_lines(docs_frame([(1, text)]).limit(0)).count() == 0


def test_line_dedup_finds_short_passages(docs_frame):
    docs, inside = [], {}
    for n in range(2, 7):
        for kind in range(40):
            for copy in range(3):
                at = len(docs)
                docs.append((at, "\n".join([f"before {at}", *[f"passage {n} {kind} line {k}" for k in range(n)], f"after {at}", f"end {at}"])))
                inside[at] = (n, copy)
    got = line_rows(linededup.dedup_lines(docs_frame(docs)))
    assert got == sql_rows(docs)
    for n in range(2, 7):
        # an outer line is in one of eight chunkings' chunks with more than 0.90, an inner one with more than 0.996
        least = (2 * 0.9 + (n - 2) * 0.996) / n - 0.1
        share = [got[i][1] / n for i, (m, copy) in inside.items() if m == n and copy]
        assert max(share) <= 1 and sum(share) / len(share) >= least, (n, sum(share) / len(share))
    assert all(got[i][1] == 0 for i, (_, copy) in inside.items() if not copy)


def test_line_dedup_compares_bytes(docs_frame, monkeypatch):
    rows = [(i, "\n".join(f"{w} {k}" for k in range(8))) for i, w in enumerate(["aa", "bb", "aa", "cc", "bb"])]
    wanted = sql_rows(rows)
    monkeypatch.setattr(linededup, "chunk_key", lambda low, high, n: F.struct(F.lit(1).alias("a"), F.lit(1).alias("b"), n.alias("n")))
    assert line_rows(linededup.dedup_lines(docs_frame(rows))) == wanted and wanted[2][1] >= 7


def test_line_dedup_of_a_long_text(docs_frame):
    lines = [f"line {k} of a long text" for k in range(60_000)]  # above 1 MB
    rows = [(1, "\n".join(lines)), (2, "\n".join(["other", *lines[1000:59_000]])), (3, "x")]
    got = line_rows(linededup.dedup_lines(docs_frame(rows)))
    assert got[1][1] == 0 and got[2][1] > 0.95 * 58_000 and got[3][1] == 0


def brute(rows, is_query, k):
    """(vec_id, score) of the best k for each query id; rows of one id all count."""
    out = {}
    for q, v in rows:
        if is_query(q):
            out.setdefault(q, []).extend((-sum(int(a) * int(b) for a, b in zip(v, w)), i) for i, w in rows if i != q)
    return {q: [(i, -s) for s, i in sorted(found)[:k]] for q, found in out.items()}


def whole(rows):
    return [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(v).all()]


def collected(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    return out


def vector_rows():
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 40)]) for i in range(600)]
    rows += [(i, list(rows[3][1])) for i in range(600, 630)]  # ties
    rows += [(i, list(rows[i][1])) for i in (50, 51)]  # repeated rows
    rows += [(7, [1.0] * 40), (20, [1.0] * 40), (None, [0.1] * 40)]  # one id, unlike vectors
    return rows + [(700, None), (701, [None] + [0.1] * 39), (702, [float("nan")] * 40), (703, [float("inf")] * 40), (705, [0.5] * 7), (706, [])]


def test_top_k_is_brute_force(spark):
    rows = vector_rows()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("score", F.lit("x")).withColumn("row", F.lit("x"))
    got = collected(topk.top_k(topk.quantise(df, "vec_id", "embedding"), F.col("vec_id") % 10 == 0, 5, cell_numbers=1))
    assert got == brute(whole(rows), lambda i: i % 10 == 0, 5)


def test_top_k_counts_repeated_rows_as_its_sql_does(spark):
    rows = [r for r in vector_rows() if r[0] is not None]
    df = spark.createDataFrame([(i % 100, v) for i, v in rows], "vec_id long, embedding array<double>")
    got = topk.top_k(topk.quantise(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).collect()
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [(i % 100, v) for i, v in rows if v is None or len(v) == 40])
    wanted = con.execute(topk.OP2_SQL).fetchall()
    got = [tuple(r) for r in got]
    assert len(got) == 10 and sorted(got) == sorted(wanted)


def test_few_candidates_and_big_numbers(spark):
    rows = [(0, [1.0, 2.0]), (1, [-1.0, 2.0]), (50, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = collected(topk.top_k(topk.quantise(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5))
    assert got == brute(whole(rows), lambda i: i % 50 == 0, 5)
    who, found, score, _ = topk.cell_top_k(np.array([[10**9, 1]]), np.array([9]), np.array([-np.inf]), np.array([[10**9, 2], [1, 5]]), np.array([3, 4]), 5)
    assert who.tolist() == [9, 9] and found.tolist() == [3, 4] and score.tolist() == [10**18 + 1, 2 * 10**9 + 5]
    # finite components of any size: numbers and scores stop at the ends of a long
    rows = [(0, [1e300, 1.0]), (1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 1.0]), (4, [1e9, 1e9]), (50, [1e9, 1.0])]
    got = collected(topk.top_k(topk.quantise(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding"), F.col("vec_id") % 50 == 0, 5))
    assert [s for _, s in got[0]] == [2**63 - 1] * 3 + [256 * 256, -(2**63)] and [i for i, _ in got[0]] == [1, 4, 50, 3, 2]
    assert got[50][:2] == [(0, 2**63 - 1), (1, 2**63 - 1)] and (4, 256 * 256 * 10**18 + 256 * 256 * 10**9) not in got[50]


def test_bounds_leave_out_most_of_the_products(spark):
    df = topk.quantise(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), "vec_id", "embedding")
    ids, v = topk.matrix(*(df.toArrow().column(c) for c in ("vec_id", "v")), 64)
    asked = ids % 50 == 0
    sure = topk.sample_scores(v[asked], ids[asked], v[::4], ids[::4], 5)
    who, found, score, share = topk.cell_top_k(v[asked], ids[asked], sure, v.T, ids, 5)
    assert share < 0.5
    for i in range(0, len(who), 5):
        whole_score = v @ v[ids == who[i]][0]
        order = [j for j in np.lexsort((ids, -whole_score)) if ids[j] != who[i]][:5]
        assert found[i : i + 5].tolist() == ids[order].tolist() and score[i : i + 5].tolist() == whole_score[order].tolist()


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert topk.top_k(topk.quantise(df, "vec_id", "embedding"), F.col("vec_id") % 50 == 0).count() == 0
