import random
import zlib

import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])
LABEL = T.StructType([T.StructField(n, T.IntegerType() if n != "doc_id" else T.LongType()) for n in ("doc_id", "quality", "toxic")])
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
WORDS = {
    "en": "the of and river stone light water people house morning paper window garden street number letter".split(),
    "de": "der die und straße über größe können schön müssen haus wasser morgen brief garten zahl fenster".split(),
}
INSULTS = ["idiot", "moron", "scum"]


def prose(r: random.Random, lang: str, n: int) -> str:
    words = [r.choice(WORDS[lang]) + r.choice(["", "", "er", "ing" if lang == "en" else "ung"]) for _ in range(n)]
    return " ".join(w + ("." if k % 9 == 8 else "") for k, w in enumerate(words))


def make(r: random.Random, n: int = 160):
    docs, labels = [], []
    for k in range(n):
        lang = r.choice(["en", "de"])
        text = prose(r, lang, r.randint(5, 120))
        toxic = int(k % 4 == 0)
        if toxic:
            words = text.split()
            for w in r.sample(INSULTS, 2):
                words.insert(r.randint(0, len(words)), w)
            text = " ".join(words)
        if k % 10 == 7:
            text = docs[-1][1]
        if k % 10 == 9 and len(docs[-1][1].split()) > 60:
            text = docs[-1][1] + " tail"
        if k % 13 == 5:
            text += f" mail me.{k}@host.example.com or +1 (2{k % 90 + 10}) 555-{1000 + k} from 10.0.{k}.255, card 4111 1111 1111 1111"
        docs.append((k * 3, text, lang if k % 11 else None, f"s{k % 4}" if k % 9 else None, len(text)))
        labels.append((k * 3, 1, toxic))
    return docs, labels


def write(spark, path, docs, labels, pages):
    spark.createDataFrame(docs, DOCUMENT).coalesce(2).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, LABEL).write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(pages, PAGE).write.parquet(f"{path}/pages.parquet")
    return str(path)


@pytest.fixture(scope="session")
def plain(spark, tmp_path_factory):
    docs, labels = make(random.Random(4))
    return write(spark, tmp_path_factory.mktemp("plain"), docs, labels, [(1, "u", "<p>x</p>")])


@pytest.fixture(scope="session")
def odd(spark, tmp_path_factory):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows."""
    docs, labels = make(random.Random(5), 40)
    docs += [(None, None, None, None, None), (None, "only text", None, None, None), (1000, None, None, None, None), (1001, "", "en", "s0", 0), (1002, " \t\n\x0b ", "en", "s1", 5)]
    docs += [(1003, prose(random.Random(6), "en", 30_000), "en", "s2", None), (1004, "x" * 50_000, None, "s3", None), (1005, "\x01\x02 a@b.c \x01", "en", "s0", 3)]
    docs += [docs[3], docs[3], (docs[3][0], "another text of the same id", "en", "s0", 9), (1006, "😀 漢字 ñ", "en", "s0", 6)]
    labels += [(None, None, None), (1001, None, 1), (1001, 0, 0), (1003, 1, None)]
    pages = [(None, None, None), (1, "u", None), (2, None, ""), (3, "u", "<p>" + "a b " * 30_000), (3, "u", "<p>" + "a b " * 30_000), (4, "u", "<<<&&& <a href='x"), (5, "u", "plain text")]
    return write(spark, tmp_path_factory.mktemp("odd"), docs, labels, pages)


@pytest.fixture(scope="session")
def empty(spark, tmp_path_factory):
    return write(spark, tmp_path_factory.mktemp("empty"), [], [], [])


def fold(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0
