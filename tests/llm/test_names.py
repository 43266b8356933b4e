"""Columns given by names with dots and blanks."""

from tidemark.llm import bpe_trie, language, licenses, sharding, simhash


def test_names_with_dots(spark):
    rows = [(i, f"the house {i} and the dog" if i % 2 else f"das haus {i} und der hund", ["de", "en"][i % 2]) for i in range(30)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    odd = docs.withColumnsRenamed({"id": "d.id", "text": "the text.x"})
    strip = lambda found: sorted(map(tuple, found.collect()))
    plain = docs.withColumnRenamed("id", "doc_id")
    assert strip(sharding.shard_by_bytes(odd, 3, "d.id", "the text.x")) == strip(sharding.shard_by_bytes(plain, 3))
    assert strip(simhash.near_duplicates(odd, id_col="d.id", text_col="the text.x")) == strip(simhash.near_duplicates(plain))
    assert simhash.deduplicate(odd, id_col="d.id", text_col="the text.x").columns == odd.columns
    assert strip(licenses.scan(odd, ["d.id"], text_col="the text.x").drop("spans")) == strip(licenses.scan(plain, ["doc_id"]).drop("spans"))
    named = docs.withColumnRenamed("id", "d.id")
    assert strip(language.identify(named, "d.id")) == strip(language.identify(plain))


def test_very_long_and_repeated_texts_in_simhash(spark):
    long = " ".join(f"w{i * 7919 % 997}" for i in range(200_000))
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + " end"), (4, "x"), (4, "x"), (5, None), (6, "")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 1), (4, 4), (4, 4), (5, 5), (6, 5)]
    assert bpe_trie.encode(docs, _path(), ["doc_id"]).count() == 7


def _path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
