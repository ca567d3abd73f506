import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")

#: Rows that every operator must stand: nulls, nothing but space, odd spaces, long texts, repeated rows and doc_ids.
ODD = [
    (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n\x0b\x0c\r ", None, None), (4, "one", "de", "b"), (5, "one", "de", "b"), (5, "one", "de", "b"), (5, "another text of the same id", "fr", "b"),
    (6, "non breaking   em space \u0085 nel é é \U0001f600 日本語", "fr", "c"), (7, "x" * 20_000, "en", "a"), (8, "word " * 6_000, "en", "a"), (None, "no id at all here", "en", "a"), (None, "no id at all here", "en", "a"), (-9, "a \x00 b�", "en", ""), (2**62, "a b\nc d\na b\n", "en", "a"),
]
SCHEMA = "doc_id bigint, text string, lang string, source string"


def invented(rng: random.Random, n: int, vocabulary: int = 400) -> str:
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))
