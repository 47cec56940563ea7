"""The stages one after the other, each on its own input."""


import corpus_pipeline as P
from trackguard.llm import decontaminate, mixing, near_duplicates, toxicity


def test_stages_and_run(spark, sf, tmp_path):
    first = docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, sf)
        if name != P.STAGES[-1][0]:
            assert out.columns == first.columns
            out.write.parquet(str(tmp_path / name))
            out = spark.read.parquet(str(tmp_path / name))
        kept[name] = (docs, out)
        docs = out

    def ids(df):
        return sorted(r.doc_id for r in df.select("doc_id").collect())
    before, after = kept["toxicity"]
    machine = toxicity.fit(before, spark.read.parquet(f"{sf}/labels.parquet"))
    assert ids(after) == ids(toxicity.score(before, machine).filter("predicted = 0"))
    before, after = kept["near duplicates"]
    assert ids(after) == ids(near_duplicates.duplicates(before).filter("kept"))
    before, after = kept["decontamination"]
    assert ids(after) == ids(decontaminate.scan(before, spark.read.parquet(f"{sf}/benchmark.parquet")).filter("not contaminated"))
    before, after = kept["mixing"]
    size = {r.doc_id: r.taken // r.size for r in mixing.mix_report(before).collect() if r.size}
    assert ids(after) == sorted(i for i, n in size.items() for _ in range(n))
    before, after = kept["token files"]
    assert ids(after) == ids(before) and sorted(r.start for r in after.collect())[0] == 0
    assert sorted(map(tuple, P.run(spark, sf).collect())) == sorted(map(tuple, after.collect()))


def test_only_planted_rows_go(spark, tmp_path):
    """Clean documents stay; a copy, a leak and nothing else go in the stages made for them."""
    text = [" ".join(f"w{k}n{j}" for j in range(60)) for k in range(20)]
    leak = " ".join(f"bench{j}" for j in range(12))
    rows = [(k, t) for k, t in enumerate(text)] + [(100, text[3]), (101, text[4] + " more"), (102, text[5].replace("w5n2 ", "") + " " + leak)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    left = P.untested(spark, P.unique(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted(r.doc_id for r in left.collect()) == [*range(20)]
