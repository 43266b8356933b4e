import os

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tidemark.llm import common


@given(st.lists(st.binary(max_size=40), max_size=8))
@settings(max_examples=150, deadline=None)
def test_word_spans_are_what_split_gives(texts):
    data, offsets = common.bytes_of(pa.array(texts, pa.binary()))
    starts, ends, first = common.word_spans(data, offsets)
    raw = data.tobytes()
    got = [[raw[a:b] for a, b in zip(starts[i:j], ends[i:j])] for i, j in zip(first[:-1], first[1:])]
    assert got == [t.split() for t in texts]


def test_word_hashes_in_blocks_and_of_long_words():
    words = [b"a", b"b" * 200, b"b" * 64 + b"c" * 64, b"c" * 64 + b"b" * 64, b"a", b"ab", b"ba"]
    data, ends = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    starts = ends - [len(w) for w in words]
    whole = common.word_hashes(data, starts, ends)
    assert (whole == common.word_hashes(data, starts, ends, block=5)).all()
    assert whole[0] == whole[4] and len(set(whole.tolist())) == len(set(words))
    assert len(common.word_hashes(data, starts[:0], ends[:0])) == 0


def test_prefix_sums(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("x"), (F.col("id") % 3).alias("g"))
    got = common.prefix_sums(df, [F.col("x")], {"before": F.col("x")}).collect()
    assert {r["x"]: r["before"] for r in got} == {x: x * (x - 1) // 2 for x in range(1000)}
    by = common.prefix_sums(df, [F.col("g"), F.col("x")], {"rank": F.lit(1)}, ["g"]).collect()
    for g in range(3):
        assert [r["rank"] for r in sorted((r for r in by if r["g"] == g), key=lambda r: r["x"])] == list(range(sum(r["g"] == g for r in by)))


def test_only_the_result_stays(spark):
    made = []

    def make():
        made.append(common.materialise(spark.range(9), "way"))
        return made[0].where("id > 3")

    before = common.materialise(spark.range(2), "before")
    held = common.only_result(spark, "result", make)
    assert held.count() == 5 and before.count() == 2
    files = [f for f in os.listdir(common.shared_dir(spark).removeprefix("file://")) if f.split("-")[0] in ("way", "result")]
    assert [f.split("-")[0] for f in files] == ["result"]


def test_shared_folder(spark):
    held = common.materialise(spark.range(5), "t")
    assert held.count() == 5
    where = common.shared_dir(spark).removeprefix("file://")
    assert os.path.isdir(where)
    common.clear_shared(spark)
    assert not os.path.exists(where)
