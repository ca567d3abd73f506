import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from loomq.llm import token_planes as tp
from loomq.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")


@pytest.mark.parametrize("bits", [1, 8])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 9, 1000])
def test_planes_round_trip(bits, n):
    ids = np.random.default_rng(n).integers(0, 2**31, n).astype(np.uint32)
    assert (tp.from_planes(tp.to_planes(ids, bits), n, bits) == ids).all()
    assert len(tp.to_planes(np.array([0, 5], np.uint32))) == 3  # planes over the highest bit are left out


@pytest.mark.parametrize("bits", [1, 8])
def test_shard_random_access(bits):
    rng = np.random.default_rng(1)
    w, out = tp.ShardWriter(bits, block=64), []
    out.append(w.header())
    docs = [rng.integers(0, 50_000, k).astype(np.uint32) for k in (0, 3, 500, 64, 1, 0, 129)]
    for k, ids in enumerate(docs):
        out += w.add(np.array([k]), np.array([False]), np.array([len(ids)]), ids)
    out += w.close()
    data = b"".join(x + tp.TERMINATOR for x in out)
    r, whole = tp.ShardReader(data), np.concatenate(docs)
    assert r.n_ids == len(whole) and r.first_id == tuple(range(0, len(whole), 64))
    for a, n in ((0, 0), (0, 5), (60, 10), (3, 600), (len(whole), 0)):
        assert (r.read(a, n) == whole[a : a + n]).all()
    with pytest.raises(IndexError):
        r.read(0, len(whole) + 1)
    assert [n for _, _, counts in r.docs() for n in counts] == [len(d) for d in docs]
    for damaged in (data[:-3], b"x" + data[1:], data[:4] + b"\x09" + data[5:]):
        with pytest.raises(ValueError, match="shard"):
            tp.ShardReader(damaged)


def test_word_tokens_equal_the_tokenizer():
    t = Tokenizer.from_file(PATH)
    texts = ["", " ", "Don't stop. It's THE end, isn't it?.,", "İstanbul KelvinK é. É. x.,.,", "a<|endoftext|>b <|startoftext|> c.", "1,000.5 ... ,x .y", "日本語。 ünï code x", "emoji 😀. 😀", "a" * 3000, "w. w, w w., w.,"]
    held = tp.WordTokens(PATH, most=8)  # so small that it is emptied between calls
    for _ in range(2):
        counts, ids = held.encode(pa.array(texts), 1)
        ends = np.concatenate([[0], np.cumsum(counts)])
        for k, x in enumerate(texts):
            assert ids[ends[k] : ends[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1], x


def test_token_index(spark, odd, none):
    t = Tokenizer.from_file(PATH)
    got = tp.token_index(odd.repartition(3), PATH).drop("shard").collect()
    rows = [(r.doc_id, [*t.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in odd.collect()]
    want = sorted((i is not None, i or 0, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, ids in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == [sum(x.n_tokens for x in got[:k]) for k in range(len(got))]
    assert tp.token_index(none, PATH).count() == 0


def test_ids_read_back(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id bigint, text string")
    tp.write_shards(df, str(tmp_path / "s"), PATH, shards=4)
    t = Tokenizer.from_file(PATH)
    back = {r.doc_id: r.ids for r in tp.read_shards(spark, str(tmp_path / "s")).collect()}
    assert back == {k: [*t.encode(f"text number {k}", add_special_tokens=False).ids, 1] for k in range(50)}


def fuzzed(n, seed=5):
    """Strings of letters that fold or normalise oddly, marks, stops, spaces of all kinds and special tokens."""
    import random

    rng = random.Random(seed)
    parts = [*"aBzé09İIıßǅΣςKÅक़़̧̈́́̇日語ﬁ①²…“’'.,.,!?-_<|> 　 ​‍😀", " ", "\n", "\t", "'s", "'LL", "İ.", "İ,", "É.", "क़.", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|StartOfText|>", "word", "The", "1,000.5"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 12))) for _ in range(n)]


def test_ids_of_odd_strings_equal_the_tokenizer():
    t, held = Tokenizer.from_file(PATH), tp.WordTokens(PATH)
    texts = fuzzed(30_000)
    counts, ids = held.encode(pa.array(texts), None)
    ends = np.concatenate([[0], np.cumsum(counts)])
    want = t.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [x for k, x in enumerate(texts) if ids[ends[k] : ends[k + 1]].tolist() != want[k].ids]
    assert held.by_words and not wrong, wrong[:5]


def test_other_tokenizers_get_whole_texts():
    path = tokenizer_path("byte_bpe_50k.json")
    t, held = Tokenizer.from_file(path), tp.WordTokens(path)
    texts = ["Hello world, two", "", *fuzzed(500, 6)]
    counts, ids = held.encode(pa.array(texts), 1)
    ends = np.concatenate([[0], np.cumsum(counts)])
    assert not held.by_words and all(ids[ends[k] : ends[k + 1]].tolist() == [*t.encode(x, add_special_tokens=False).ids, 1] for k, x in enumerate(texts))


def test_a_very_long_text_and_a_store_bounded_by_bytes():
    t, held = Tokenizer.from_file(PATH), tp.WordTokens(PATH, most_bytes=1 << 16)
    text = " ".join(f"word{k % 5000}, {'ab' * (k % 40)}." for k in range(100_000))  # some 5 MB
    counts, ids = held.encode(pa.array([text]), None)
    assert counts.tolist() == [len(ids)] and ids.tolist() == t.encode(text, add_special_tokens=False).ids
    held.encode(pa.array(["next"]), None)
    assert len(held.store.place) < 5  # emptied, as it had passed its bytes


def test_words_found_again_outlive_the_others():
    held, learned = tp.WordTokens(PATH, most=2000), []
    learn, common = held._learn, [f"common{k}" for k in range(300)]
    held._learn = lambda words: (learned.extend(words), learn(words))
    t = Tokenizer.from_file(PATH)
    for k in range(20):
        text = " ".join([*common, *(f"once{k}x{i}." for i in range(400))])
        counts, ids = held.encode(pa.array([text]), 1)
        assert ids.tolist() == [*t.encode(text, add_special_tokens=False).ids, 1] and counts.tolist() == [len(ids)]
        assert len(held.store.place) <= 2000
    assert sum(w.startswith("common") for w in learned) == 300


#: Anonymous memory that a worker adds, at most, over 20 MB with many words that occur once, in batches as Spark's.
WORKER = r"""
import random, re, sys
import pyarrow as pa
from loomq.llm import token_planes as tp

def anon():
    return sum(map(int, re.findall(r"\nPss_(?:Anon|Shmem):\s+(\d+)", open("/proc/self/smaps_rollup").read()))) / 1024

def batches():
    rng = random.Random(1)
    for k in range(2):
        texts = [" ".join(f"w{rng.randrange(3000)}" if rng.random() < 0.9 else f"n{rng.getrandbits(30)}." for _ in range(350)) for _ in range(5000)]
        yield pa.record_batch([pa.array(range(5000)), pa.array(texts)], names=["doc_id", "text"])

given = list(batches())
tp.word_tokens(sys.argv[1])
start = most = anon()
encode = tp.WordTokens.encode
def watched(*args):
    global most
    out = encode(*args)
    most = max(most, anon())
    return out
tp.WordTokens.encode = watched
for _ in tp.shard_records(given, sys.argv[1], 1, 1):
    most = max(most, anon())
print(most - start)
"""


def test_a_worker_holds_little_memory():
    ran = subprocess.run([sys.executable, "-c", WORKER, PATH], cwd=Path(__file__).parents[2], capture_output=True, text=True)
    assert ran.returncode == 0, ran.stderr
    assert float(ran.stdout) < 180


def test_digests_without_ids(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text number {k}") for k in range(50)], "doc_id bigint, text string")
    tp.write_shards(df, str(tmp_path / "s"), PATH, shards=4)
    whole, digests = (tp.read_shards(spark, str(tmp_path / "s"), with_ids=x) for x in (True, False))
    assert digests.columns == whole.columns[:-1]
    assert sorted(digests.collect()) == sorted(whole.drop("ids").collect())
