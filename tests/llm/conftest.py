import pytest
from pyspark.sql import Row

from docket.llm.common import tokenizer


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, one-word and very long texts, repeated rows and texts, special
    strings, characters outside Latin, and columns that clash with the operators' own names."""
    long = " ".join(f"word{i % 97} and" for i in range(30_000))
    texts = [None, "", " ", "one", "two words", "same text here now", "same text here now", "same  text\there now",
             "<|endoftext|> in <|startoftext|> text", "Größe İstanbul ʼn ﬁne 漢字 ½²３ é \x1c\x85\xa0x", long, long,
             "It's WE'LL they're 123 4567 ... !!! ĳŉ ſ ªº", "\n\n\t x  y   z \n", "a" * 3000, "\x00 nul ​ zero 😀😀"]
    rows = [Row(doc_id=i, text=t, lang="en" if i % 2 else None, source=None, n_chars=None,
                n=1, norm="x", digest="y", piece=3, key=None) for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], Row(doc_id=None, text="no id", lang=None, source=None, n_chars=None, n=1, norm="x",
                                   digest="y", piece=3, key=None),
             Row(doc_id=None, text="same text here now", lang="de", source=None, n_chars=None, n=1, norm="x",
                 digest="y", piece=3, key=None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, "
                                       "n int, norm string, digest string, piece int, key string").cache()


@pytest.fixture(scope="session")
def word_bpe():
    return tokenizer("word_bpe_49k.json")


@pytest.fixture(scope="session")
def byte_bpe():
    return tokenizer("byte_bpe_50k.json")
