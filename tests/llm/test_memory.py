"""What near-dedup's tasks hold: no row for a shingle in the JVM, nothing of other stages in a reused Python worker."""

from spanloom.llm import common, simhash, tokens
from spanloom.llm.common import small_batches


def shuffled_rows(spark) -> dict[int, int]:
    """Rows that each stage so far has written to a shuffle."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteRecords() for i in range(stages.size())}


def test_counting_sends_no_row_for_a_shingle(spark):
    texts = [" ".join(f"{i}w{j}" for j in range(400)) for i in range(300)] + ["said three times or more often"] * 3 + [None, ""]
    docs = small_batches(spark.createDataFrame([(t,) for t in texts], "text string").repartition(3))
    before = shuffled_rows(spark)
    shingles, counts = simhash.common_shingles(docs)
    assert sorted(shingles.tolist()) == sorted(simhash.shingle_hashes("said three times or more often", 5).view("int64").tolist()) and counts.tolist() == [3, 3]
    assert max(n for k, n in shuffled_rows(spark).items() if k not in before) < 10_000


def test_a_lean_task_forgets_the_tokenizers_words():
    tokens.encoder(tokens.tokenizer_path()).ids(["some words"])
    assert tokens.encoder.cache_info().currsize == 1
    common.lean()
    assert tokens.encoder.cache_info().currsize == 0
