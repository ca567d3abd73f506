import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from loomq.llm import piece_viterbi as v
from loomq.llm.queries import tokenizer_path

PATH = tokenizer_path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def held():
    return v.Pieces(PATH)


@pytest.fixture(scope="module")
def library():
    """The SentencePiece library on the same pieces and scores, as a unigram model."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    with open(PATH, "rb") as f:
        model = pb.ModelProto.FromString(f.read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def texts():
    rng = random.Random(3)
    out = ["", " ", "  a", "a  b ", "x\n\n y\n", "\n", "日本語 é\t☃", "a▁b", "▁", "e" * 300, "\n\n", " \n ", "The quick brown fox. Über-straße naïve \U0001f600"]
    out += ["".join(rng.choice("ab \n▁é☃th") for _ in range(rng.randrange(30))) for _ in range(500)]
    return out + ["".join(rng.choice("theanding.,") for _ in range(rng.randrange(1, 12))) for _ in range(500)]


def split(counts, ids):
    ends = np.concatenate([[0], np.cumsum(counts)]).tolist()
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:], strict=False)]


def brute(held, library, text):
    """The best sum of scores over all segmentations of the whole text, by a plain loop."""
    if not text:
        return 0.0
    norm = "▁" + text.replace(" ", "▁")
    score = {library.id_to_piece(i): library.get_score(i) for i in range(library.get_piece_size()) if not library.is_byte(i) and not library.is_control(i) and not library.is_unknown(i)}
    best = [0.0] + [-1e30] * len(norm)
    for e in range(1, len(norm) + 1):
        for s in range(max(0, e - 16), e):
            if norm[s:e] in score:
                best[e] = max(best[e], best[s] + score[norm[s:e]])
        if norm[e - 1] not in score:
            best[e] = max(best[e], best[e - 1] + held.unknown_score)
    return best[-1]


def test_best_sums_and_library(held, library):
    all_texts = texts()
    found = split(*held.encode(pa.array(all_texts)))
    differ = 0
    for t, ids in zip(all_texts, found, strict=True):
        if ids != library.encode(t):
            differ += 1
    assert differ < 0.02 * len(all_texts)  # the library's own search is off the best sum now and then; see below
    score = lambda ids: sum(library.get_score(i) for i in ids)
    plain = [t for t in all_texts[-60:] if t]
    for t in plain:
        ids = held.encode(pa.array([t]))[1].tolist()
        assert score(ids) == pytest.approx(brute(held, library, t)) and score(ids) >= score(library.encode(t)) - 1e-6


def test_decoding_gives_the_text_back(held, library):
    all_texts = texts()
    assert held.decode(*held.encode(pa.array(all_texts))) == [t.replace("▁", " ") for t in all_texts]
    ids = [1, 272, 2, 0, 300]
    assert held.decode(np.array([5]), np.array(ids)) == [library.decode(ids)]


def test_frames(spark, odd, none):
    rows = v.encoded(odd, PATH, check=True).collect()
    assert len(rows) == odd.count()
    want = sorted((r.doc_id or 0, r.text is None, hashlib.sha256((r.text or "").encode()).hexdigest()) for r in odd.collect())
    assert sorted((r.doc_id or 0, r.ids is None, r.decoded_sha256 or hashlib.sha256(b"").hexdigest()) for r in rows) == want
    assert all(r.n_ids == len(r.ids) for r in rows if r.ids is not None)
    back = v.decoded(v.encoded(odd, PATH), PATH).collect()
    assert sorted(((r.doc_id or 0, r.text) for r in back), key=str) == sorted(((r.doc_id or 0, r.text) for r in odd.collect()), key=str)
    assert v.encoded(none, PATH).count() == 0


def test_a_small_store_changes_nothing(held):
    small = v.Pieces(PATH, most=50)
    for k in range(0, 200, 20):
        part = pa.array(texts()[k : k + 20])
        assert split(*small.encode(part)) == split(*held.encode(part))


def plain_ids(held, text):
    """The ids by a plain loop over the whole normalised text: best sum, ties to the longer last piece."""
    if not text:
        return []
    norm = "▁" + text.replace(" ", "▁")
    table = {"".join(map(chr, c)): (float(s), int(i)) for _, ids, scores, letters in held.tables.values() for c, i, s in zip(letters.tolist(), ids, scores, strict=True)}
    best, back = [0.0] + [-np.inf] * len(norm), [(0, 0)] * (len(norm) + 1)
    for e in range(1, len(norm) + 1):
        for s in range(max(0, e - max(held.tables)), e):  # the longest first
            if norm[s:e] in table and best[s] + table[norm[s:e]][0] > best[e]:
                best[e], back[e] = best[s] + table[norm[s:e]][0], (s, table[norm[s:e]][1])
        if norm[e - 1] not in table and best[e - 1] + held.unknown_score > best[e]:
            best[e], back[e] = best[e - 1] + held.unknown_score, (e - 1, -1)
    out, e = [], len(norm)
    while e:
        s, i = back[e]
        out.append([i] if i >= 0 else [int(held.bytes_at[b]) for b in norm[s].encode()])
        e = s
    return [i for x in reversed(out) for i in x]


def test_long_and_unspaced_texts_equal_a_plain_loop(held, monkeypatch):
    rng = random.Random(11)
    han = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(300)]
    cases = ["x" * 3000, "ab" * 700, "".join(rng.choice("abcdefghijklmnop/+=0123456789") for _ in range(5000)), "".join(rng.choice(han) for _ in range(4000)), "\n".join("".join(rng.choice(han + [*"the。，"]) for _ in range(200)) for _ in range(20)), "the quick brown fox\njumps  over " * 200]
    cases += ["".join(rng.choice([*"theandingé ☃日本語\n", *han[:5]]) for _ in range(rng.randrange(1, 400))) for _ in range(60)]
    for window in (v.WINDOW, 37):
        monkeypatch.setattr(v, "WINDOW", window)
        held.store.clear()
        found = split(*held.encode(pa.array(cases)))
        assert [k for k, t in enumerate(cases) if found[k] != plain_ids(held, t)] == []


def test_unspaced_text_takes_no_more_than_five_times_as_long():
    import time

    rng = random.Random(12)
    han = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(3000)]
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(2, 9))) for _ in range(20_000)]
    spaced = " ".join(rng.choice(words) for _ in range(17_000))[:100_000]
    unspaced = "".join(rng.choice(han) for _ in range(100_000))

    def seconds(texts):
        fresh = v.Pieces(PATH)
        at = time.perf_counter()
        fresh.encode(pa.array(texts))
        return time.perf_counter() - at

    base = min(seconds([spaced]) for _ in range(3))
    assert min(seconds([unspaced]) for _ in range(3)) < 5 * base and min(seconds([unspaced[k : k + 500] for k in range(0, 100_000, 500)]) for _ in range(3)) < 5 * base


def test_a_hit_of_another_string_is_no_hit(held, monkeypatch):
    """Where a table's hashes were those of other strings, none of its pieces would be found, and the text still be encoded."""
    keys, ids, scores, letters = held.tables[2]
    monkeypatch.setitem(held.tables, 2, (keys, ids, scores, np.zeros_like(letters)))
    held.store.clear()
    for text in ("thine and there", "x" * 200):
        got = held.encode(pa.array([text]))[1]
        assert not set(got.tolist()) & set(ids.tolist()) and held.decode(np.array([len(got)]), got) == [text]
    held.store.clear()
