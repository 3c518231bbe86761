"""The pipeline's stages, held against brute force where they filter."""
import re
from collections import Counter

from test_small import expected_targets, linked
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quarry.llm.token_files import tokenizer_path

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def windows(ws, n=8):
    return {tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)}


def test_decontamination_drops_each_benchmark_passage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = set().union(*(windows(words(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    rows = docs.collect()
    clean = sorted(r.doc_id for r in rows if not windows(words(r.text)) & bench)
    kept = pipeline.benchmark_decontamination(spark, docs, SF)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == clean and len(clean) < len(rows)


def test_short_items_remove_nothing(spark, tmp_path):
    spark.createDataFrame([(1, "new york"), (2, None), (3, ""), (4, "one two three four five six seven eight nine")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame(
        [(1, "from New York to here", "en", "a", 1), (2, "x ONE two three four, five six seven eight y", "en", "a", 1), (3, "one two three four five six seven", "en", None, 1), (None, None, None, None, None), (5, "", "en", "b", 0)], SCHEMA)
    assert sorted(str(r.doc_id) for r in pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == ["1", "3", "5", "None"]
    none = docs.limit(0)
    assert pipeline.benchmark_decontamination(spark, none, str(tmp_path)).count() == 0


def test_items_of_five_to_seven_words_remove_by_themselves(spark, tmp_path):
    spark.createDataFrame([(1, "What is the capital of France?"), (2, "Name Five Big Red Dogs"), (3, "one two three four"), (4, "red green blue pink")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts = ["x what is the capital of france y", "name five big red dogs", "one two three four x red green blue pink", "what is the capital of spain", "five big red dogs name"]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], SCHEMA)
    assert sorted(r.doc_id for r in pipeline.benchmark_decontamination(spark, docs, str(tmp_path)).collect()) == [2, 3, 4]


def test_run(spark):
    at = spark.read.parquet(f"{SF}/documents.parquet")
    columns = at.columns
    assert [len(s) for s in pipeline.STAGES] == [2] * 5
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = at.count()
        at = stage(spark, at, SF)
        if k < 4:
            path = f"{spark.conf.get('spark.checkpoint.dir')}/pipeline-test-{k}"
            at.write.mode("overwrite").parquet(path)
            at = spark.read.parquet(path)
            assert at.columns == columns, name
        if k < 3:
            assert 0 < at.count() < before, name  # every filter takes effect
            assert at.count() > 0.7 * before, name  # and leaves most documents alone
    assert at.count() > 0 and {"doc_id", "start", "n_tokens", "ids_crc32"} <= set(at.columns)


def test_near_duplicates_stage_against_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    groups = linked([r.text for r in rows], 5, 80)
    empty = {k for k, (_, n) in enumerate(groups) if n == 0}
    want = sorted(rows[k].doc_id for k, (head, _) in enumerate(groups) if head == k or k in empty)
    assert sorted(r.doc_id for r in pipeline.near_duplicates(spark, docs, SF).collect()) == want


def test_mixing_and_token_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    rows = docs.collect()
    sizes, mixed = {}, {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    out = pipeline.mixing(spark, docs, SF)
    assert out.columns == docs.columns
    times = Counter(r.doc_id for r in out.collect())
    assert max(times.values()) <= 2 and set(times) <= {r.doc_id for r in rows}
    for r in rows:
        mixed[r.source] = mixed.get(r.source, 0) + size(r.text) * times[r.doc_id]
    longest = max(size(r.text) for r in rows)
    for source, target in expected_targets(sizes).items():
        assert abs(mixed[source] - target) <= longest
    tokens = pipeline.token_output(spark, docs, SF).collect()
    library = Tokenizer.from_file(tokenizer_path())
    assert {r.doc_id: r.n_tokens for r in tokens} == {r.doc_id: len(library.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in rows}


def test_run_on_empty_and_odd_tables(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(None, None)], "item_id long, text string")
    odd = [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, "w " * 30, "en", None, 5), (3, "w " * 30, "en", "b", 5), (None, "x" * 50_000, "en", "b", 5)]
    for k, rows in enumerate(([], odd)):
        folder = f"{tmp_path}/{k}"
        spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        got = pipeline.run(spark, folder).collect()
        assert (len(got) > 0) == bool(rows)
