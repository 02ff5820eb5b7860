import random
import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from corpusloom.llm import sentencepiece_codec, token_counts, viterbi

BPE, MODEL = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = ["", None, " ", "\n\n", "a<|endoftext|>b<|endoftext|>", "<|endoftext|", "don't  we'll x", "ࢗ\U0001d6a6 x", "日本語 テスト", "a" * 3000, "x y " * 2000, "  lead", "trail  ", "1234 ½²", "▁a ▁", "\x00a", "é́"]


def mixed(n, seed=5):
    rng = random.Random(seed)
    return ["".join(rng.choice("abcdefthe  \n\té日1▁.,'") for _ in range(rng.randrange(1, 600))) for _ in range(n)]


def test_agreed_characters():
    """The two splitters agree on every character that the fast path takes."""
    tok, _, _ = token_counts._tools(BPE)
    import regex

    fine = regex.compile(f"[{token_counts.AGREED}]")
    pattern = regex.compile(P.PATTERN)
    chars = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000 and fine.match(chr(c))]
    for at in range(0, len(chars), 4000):
        text = "".join(f"a{c}a1{c}1!{c}! {c}!b\n" for c in chars[at : at + 4000])
        assert pattern.findall(text) == [text[a:b] for _, (a, b) in tok.pre_tokenizer.pre_tokenize_str(text)]


@pytest.mark.parametrize("head", [0, 3, 200_000])
def test_token_counts(spark, head):
    texts = ODD + mixed(40) + ["same text"] * 3
    rows = [(i % 50, t, 7, "x") for i, t in enumerate(texts)] + [(None, "no id", 7, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long, pretoken string")
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(df, BPE, head_rows=head).collect())
    tok = Tokenizer.from_file(BPE)
    want = []
    for i, t, _, _ in rows:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        want.append((-1 if i is None else i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want)


def test_token_counts_empty(spark):
    assert token_counts.token_counts(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def test_segmentation_is_the_library_s():
    sp, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), viterbi.load(MODEL)
    texts = [t or "" for t in ODD] + mixed(150, 9) + [" " * 1000, "".join(random.Random(1).choice("abcdefghij0123+/=") for _ in range(5000))]
    got = [x.tolist() for x in m.encode(texts)]
    assert got == sp.encode(texts)
    flat, ends = np.array([i for x in got for i in x]), np.cumsum([len(x) for x in got])
    assert m.decode(flat, ends) == [t.replace("▁", " ") for t in texts] == [sp.decode(x) for x in got]


def test_pairs_are_told_without_merging_them(monkeypatch):
    """Every piece of the public model is orderly: no pair has its characters merged again."""
    monkeypatch.setattr(viterbi.Pieces, "_merged", lambda *_: pytest.fail("merged"))
    sp, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), viterbi.load.__wrapped__(MODEL)
    texts = [t or "" for t in ODD] + mixed(60, 4)
    assert [x.tolist() for x in m.encode(texts)] == sp.encode(texts)
    assert m.orderly[list(m.ids.values())].all()


@pytest.mark.parametrize("levels", [3, 1000])
def test_any_byte_pair_model_is_the_library_s(levels, tmp_path):
    """Models with equal scores, with pieces that nothing merges to, and with merges that come after the ones that use them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    rng, odd, lost = random.Random(levels), 0, 0
    for at in range(60):
        letters = "ab" if at % 2 else "abc"
        # a model of long pieces alone has some that are never reached
        more = {"".join(rng.choice(letters) for _ in range(rng.randrange(2 + at % 3 % 2, 7))) for _ in range(rng.randrange(3, 40))} | {"ab"}
        spec = pb.ModelProto()
        spec.trainer_spec.model_type, spec.normalizer_spec.add_dummy_prefix, spec.normalizer_spec.remove_extra_whitespaces = 2, False, False
        for p, score, kind in [("<unk>", 0, 2), *[(p, -rng.randrange(levels), 1) for p in [*letters, *sorted(more)]]]:
            spec.pieces.add(piece=p, score=score, type=kind)
        path = tmp_path / f"{at}.model"
        path.write_bytes(spec.SerializeToString())
        sp, m = sentencepiece.SentencePieceProcessor(model_file=str(path)), viterbi.load.__wrapped__(str(path))
        texts = ["".join(rng.choice(letters + "?") for _ in range(rng.randrange(1, 30))) for _ in range(60)] + ["".join(rng.choice(letters) for _ in range(250))]
        # the library joins unknown characters that follow each other
        texts = [re.sub(r"\?+", "?", t) for t in texts]
        assert [x.tolist() for x in m.encode(texts)] == sp.encode(texts)
        whole = m.whole[list(m.ids.values())]
        lost += (~whole).any()
        odd += (whole & ~m.orderly[list(m.ids.values())]).any()
        pairs = np.array([a * m.n + b for a in m.ids.values() for b in m.ids.values()])
        first, second = np.divmod(pairs, m.n)
        both = m.whole[first] & m.whole[second]
        assert (m._met(pairs[both]) == m._merged(pairs[both])).all() and not m._met(pairs[~both]).any()
    assert odd > 5 and lost > 5


def test_words_are_forgotten_and_found_again(monkeypatch):
    monkeypatch.setattr(viterbi, "CACHE", 60)
    sp, m = sentencepiece.SentencePieceProcessor(model_file=MODEL), viterbi.load(MODEL)
    m._forget()
    for seed in range(12):
        texts = [t or "" for t in ODD[:9]] + mixed(6, seed) + mixed(2, 3) + ["some words come again and again"]
        assert [x.tolist() for x in m.encode(texts)] == sp.encode(texts)
        assert len(m.known) == len(m.length) == len(m.used) and m.length.sum() == len(m.flat)
    m._forget()


def test_unigram_by_brute_force():
    pieces, scores = ["<unk>", "▁", "a", "b", "ab", "▁a", "ba", "bab"], [0, -2.0, -3.0, -3.5, -4.0, -4.5, -4.2, -6.0]
    m = viterbi.Pieces(pieces, scores, [False] + [True] * 7, bpe=False)
    where = {p: i for i, p in enumerate(pieces) if i}

    def best(w):
        if not w:
            return 0.0, []
        options = []
        for k in range(1, len(w) + 1):
            if w[:k] in where:
                s, ids = best(w[k:])
                options.append((s + scores[where[w[:k]]], [where[w[:k]], *ids]))
        return max(options)

    for text in ("ab", "babab", "aabbab", "b a"):
        ids = m.encode([text])[0].tolist()
        full = "▁" + text.replace(" ", "▁")
        assert abs(sum(scores[i] for i in ids) - best(full)[0]) < 1e-9 and "".join(pieces[i] for i in ids) == full


def test_codec_table(spark):
    df = spark.createDataFrame([(1, "hello world"), (1, "hello world"), (2, None), (None, "a▁b")], "doc_id long, text string").selectExpr("*", "1 as ids", "2 as decoded")
    got = sentencepiece_codec.encoded_and_checked(df, MODEL).collect()
    assert len(got) == 4 and all(r.exact for r in got) and [r.n_pieces for r in got if r.doc_id == 2] == [0]
    assert sentencepiece_codec.encoded_and_checked(df.limit(0), MODEL).count() == 0
