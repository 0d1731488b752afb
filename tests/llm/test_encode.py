import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from mentionloom.llm import encode as E

RANKS = E.read_ranks(E.default_vocabulary())
TRUTH = tiktoken.Encoding("own", pat_str=E.default_pattern(), mergeable_ranks=RANKS, special_tokens={})


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_short_words(text):
    raw = text.encode()
    if raw:
        assert E._encode_short(raw, RANKS) == E._encode_long(raw, RANKS)


def test_table_against_the_library(spark):
    texts = ["", "Hello  world's\n\ttest", "don’t 😀 语言", "a" * 20_000, "the" * 3000, "x y" * 2000, " ", "<|endoftext|>"]
    df = spark.createDataFrame([*enumerate(texts), (99, None), (0, "")], "doc_id bigint, text string").selectExpr("*", "text AS ids")
    rows = E.encode_texts(df.drop("ids")).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        assert r["ids"] == (TRUTH.encode_ordinary(texts[r["doc_id"]]) if r["doc_id"] != 99 else [])
    assert E.encode_texts(df.limit(0)).count() == 0


def test_other_vocabulary(spark):
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    other = tiktoken.Encoding("o", pat_str=E.default_pattern(), mergeable_ranks=E.read_ranks(path), special_tokens={})
    df = spark.createDataFrame([(1, "Größe der Hüfte")], "doc_id bigint, text string")
    assert E.encode_texts(df, vocabulary=path).first()["ids"] == other.encode_ordinary("Größe der Hüfte")
