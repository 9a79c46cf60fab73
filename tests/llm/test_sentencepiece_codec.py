import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from cases import SCHEMA, awkward, clashing, documents, plain
from seriesloom.llm import sentencepiece_codec as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
HARD = ["Hello world, this is a test.", "a  b   c", " lead", "trail ", "émigré 漢字 \U0001f600\U0001f9ea", "line\nbreak\ttab", "x" * 90, "▁mark▁", "\x00\x01", "ß½ Ünïcode", " ", "    "]


@pytest.fixture(scope="module")
def vocab():
    return sp.load(PATH)


def test_trie_holds_exactly_the_pieces(vocab):
    rng = random.Random(1)
    pieces = [p for k, p in enumerate(vocab.pieces) if not vocab.silent[k] and k not in set(vocab.bytes_at.tolist())]
    wanted = {p: k for k, p in enumerate(vocab.pieces) if not vocab.silent[k] and k not in set(vocab.bytes_at.tolist())}

    def find(word):
        node = 0
        for b in word:
            step = vocab.base[node] + b + 1
            if vocab.check[step] != node:
                return -1
            node = step
        return vocab.piece_of[node]

    for p in rng.sample(pieces, 3000):
        assert find(p) == wanted[p]
        other = p + bytes([rng.randrange(256)])
        assert find(other) == wanted.get(other, -1)


def slow(text, vocab):
    """Best path over the whole text, place by place, all pieces tried."""
    wanted = {p: k for k, p in enumerate(vocab.pieces) if not vocab.silent[k] and k not in set(vocab.bytes_at.tolist())}
    if not text:
        return []
    chars = ("▁" + text.replace(" ", "▁"))
    best, back = [0.0] + [-np.inf] * len(chars), [None] * (len(chars) + 1)
    for end in range(1, len(chars) + 1):
        for start in range(max(0, end - 48), end):
            data = chars[start:end].encode()
            if data in wanted:
                total = best[start] + vocab.scores[wanted[data]]
            elif end - start == 1:
                total = best[start] + vocab.unknown
            else:
                continue
            if total > best[end]:
                best[end], back[end] = total, start
    out, at = [], len(chars)
    while at:
        data = chars[back[at] : at].encode()
        out[:0] = [wanted[data]] if data in wanted else [int(vocab.bytes_at[b]) for b in data]
        at = back[at]
    return out


def test_paths_equal_brute_force(vocab):
    rng = random.Random(2)
    letters = "abcdeth ing  éß漢\n."
    texts = HARD + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(150)] + [""]
    encoder = sp.Encoder(vocab)
    ids, scores = encoder([t.encode() for t in texts])
    for text, got in zip(texts, ids):
        assert got.tolist() == slow(text, vocab), text
        assert sp.decode_ids(got, vocab).decode() == text.replace("▁", " ")


def test_paths_equal_the_library_on_known_words(vocab):
    model = pb.ModelProto()
    model.ParseFromString(open(PATH, "rb").read())
    model.trainer_spec.model_type = 1  # the same pieces and scores, read as a unigram model
    library = sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())
    rng = random.Random(3)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 14))) for _ in range(500)]
    ids, scores = sp.Encoder(vocab)([w.encode() for w in words])
    for word, got, score in zip(words, ids, scores):
        other = library.encode(word)
        assert score >= sum(vocab.scores[k] for k in other) - 1e-6
        assert got.tolist() == other, word


def test_round_trip_tables(spark):
    df = clashing(awkward(spark), "ids", "score", "body")
    rows = {(r.doc_id, r.text) for r in df.collect()}
    encoded = sp.encode(df, PATH)
    back = sp.decode(encoded, PATH).collect()
    assert len(back) == df.count()
    assert {(r.doc_id, r.text) for r in back} == {(i, t or "") for i, t in rows}
    got = plain(sp.digest(df, PATH))
    assert len(got) == df.count() and all(r["same"] for r in got)
    assert sp.digest(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert sp.decode(spark.createDataFrame([(1, None, 0.0), (2, [0, -5, 99999999, 1], 0.0)], "doc_id long, ids array<int>, score double"), PATH).collect()[0].text is None


def test_small_batches_agree(spark):
    df = documents(spark, HARD * 3)
    got = plain(sp.digest(df, PATH))
    assert len({r["ids_crc32"] for r in got}) == len({t.replace("▁", " ") for t in HARD})
