import duckdb
from pyspark.sql import functions as F

from sharpfleet.llm import lines as L

from .common import DATA, empty, odd, prose


def test_equals_sql(spark):
    import hashlib

    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{DATA}/documents.parquet')")
    want = sorted(con.sql(L.OP8_SQL).fetchall())
    got = sorted((r["doc_id"], r["n_lines"], r["n_dropped"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in L.drop_lines(spark.read.parquet(f"{DATA}/documents.parquet")).collect())
    assert got == want and sum(r[2] for r in got) > 0


def by_hand(rows, least=40, copies=5):
    key = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x.strip(L.BLANK))
    docs = {}
    for r in rows:
        for x in (r["text"] or "").split("\n"):
            if r["doc_id"] is not None and len(key(x)) >= least:
                docs.setdefault(key(x), set()).add(r["doc_id"])
    for r in rows:
        lines = (r["text"] or "").split("\n")
        keep = [x for x in lines if r["doc_id"] is None or not (len(d := docs.get(key(x), ())) >= copies and max(d) > r["doc_id"])]
        yield r["doc_id"], "\n".join(keep), len(lines), len(lines) - len(keep)


def test_odd_rows(spark):
    rows = [(20 + i, "\tThis LINE has forty code points or more, é.\x0b \n" + ("  this line has forty code points or more, é." if i == 3 else "x" * (38 + i % 3))) for i in range(6)]
    docs = odd(spark).unionByName(spark.createDataFrame(rows, "doc_id long, text string"), allowMissingColumns=True)
    out = L.drop_lines(docs)
    assert sorted(map(str, ((r["doc_id"], r["text"] or "", r["n_lines"], r["n_dropped"]) for r in out.collect()))) == sorted(map(str, by_hand(docs.collect())))
    assert set(docs.columns) < set(out.columns) and L.drop_lines(empty(spark)).count() == 0


def test_runs_are_compacted_and_merge(spark):
    runs, want = L.LineRuns(spark, fanout=2), {}
    for batch in range(7):
        keys = [(100 * batch + d, k, -k) for d in range(4) for k in range(batch, batch + 3 + d)]
        runs.add(spark.createDataFrame(keys, "doc_id long, k1 long, k2 long"))
        for d, k, _ in keys:
            n, last = want.get(k, (0, -1))
            want[k] = (n + 1, max(last, d))
        assert all(len(level) < 2 for level in runs.levels)
    assert len(runs.levels) >= 3 and {r["k1"]: (r["n"], r["last"]) for r in runs.merged().collect()} == want
    assert L.LineRuns(spark).merged().count() == 0
    assert prose(1) == prose(1)


def test_columns_of_the_user_keep_their_values(spark):
    docs = odd(spark).withColumns({"_go": F.lit("go"), "_kept": F.lit("kept"), "_user": F.lit(5), "a.b": F.lit("dot"), "k1": F.lit(1.5), "n_lines": F.lit(-1)})
    out = L.drop_lines(docs)
    assert out.columns == [c for c in docs.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    rows = out.collect()
    assert len(rows) == docs.count() and all((r["_go"], r["_kept"], r["_user"], r["a.b"], r["k1"]) == ("go", "kept", 5, "dot", 1.5) and r["n_lines"] >= 1 for r in rows)
    plain = {(r["doc_id"], r["text"], r["n_dropped"]) for r in L.drop_lines(odd(spark)).collect()}
    assert {(r["doc_id"], r["text"], r["n_dropped"]) for r in rows} == plain
