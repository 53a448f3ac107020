import collections

import corpus_pipeline as C
from sharpfleet.llm.decontaminate import build_index, leaks

from .common import DATA, given
from .test_lines import by_hand
from .test_neardup import classes_by_hand
from .test_packing import check


def test_every_stage_against_brute_force(spark, tmp_path):
    docs = given(spark)
    columns = docs.columns
    for name, stage in C.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        out = spark.read.parquet(str(tmp_path / name))
        before, after = docs.collect(), out.collect()
        if name != "packing":
            assert out.columns == columns
        if name == "quality":
            labels = {r["doc_id"]: r["quality"] for r in given(spark, "labels").collect()}
            kept, known = {r["doc_id"] for r in after}, collections.Counter()
            for r in before:
                if r["doc_id"] in labels:
                    known[labels[r["doc_id"]], r["doc_id"] in kept] += 1
            assert known[1, True] >= 0.95 * (known[1, True] + known[1, False]) and known[0, False] >= 0.7 * (known[0, True] + known[0, False])
        elif name == "lines":
            assert {(r["doc_id"], r["text"]) for r in after} == {x[:2] for x in by_hand(before)} and all(r["n_chars"] == len(r["text"]) for r in after)
        elif name == "near_duplicates":
            assert {r["doc_id"] for r in after} == {k for k, c in classes_by_hand(before).items() if k == c}
        elif name == "decontamination":
            index = build_index([tuple(r) for r in given(spark, "benchmark").select("item_id", "text").collect()])
            assert {r["doc_id"] for r in after} == {r["doc_id"] for r in before if not leaks([r["text"]], index)}
        else:
            assert check(before, after) < 0.02
        docs = out


def test_run_is_the_stages_in_a_row(spark):
    out = C.run(spark, DATA)
    assert out.count() > 0 and "ids" in out.columns and [n for n, _ in C.STAGES] == ["quality", "lines", "near_duplicates", "decontamination", "packing"]
