"""The rule annotator over blocks of whole documents, in NumPy: sentences, tokens, trees and all that is told of a sentence.

A document is worked out in the task that reads it, so its tokens are never shuffled, sorted or written; only what a query
returns leaves the task. A block is some millions of characters; arrays have an entry for each token or each sentence, and words
are handled once a block. A row of the documents is a document. Letters and digits are those of Python's Unicode tables.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

LEXICON = {
    "DET": ("the", "a", "an", "this", "that"), "ADP": ("of", "in", "on", "by", "with", "for", "from", "at", "to"), "PRON": ("i", "you", "he", "she", "it", "we", "they"),
    "CCONJ": ("and", "or", "but"), "SCONJ": ("because", "if", "when", "while", "although"), "AUX": ("is", "are", "was", "were", "be", "has", "have", "had", "will", "would", "can"),
}
POS = ("NOUN", "VERB", "ADJ", "ADV", "DET", "ADP", "PRON", "CCONJ", "SCONJ", "AUX", "NUM", "PUNCT")
DEP = ("ROOT", "conj", "ccomp", "xcomp", "advcl", "pobj", "nsubj", "dobj", "advmod", "aux", "cc", "mark", "punct", "prep", "det", "amod", "nummod")
P, D = {p: i for i, p in enumerate(POS)}, {d: i for i, d in enumerate(DEP)}
_BY_WORD = {w: P[tag] for tag, listed in LEXICON.items() for w in listed}
_VERB, _ADJ = ("ed", "ing", "ize", "ise"), ("ous", "ful", "ive", "able", "ible", "al", "ic")
#: What a character is.
OTHER, LETTER, DIGIT, SPACE, MARK, BETWEEN = range(6)
#: Characters of a block, about; a longer text is a block of its own. Rows of a batch that a task returns, at most.
BLOCK, ROWS = 2 << 20, 100_000


@cache
def kinds() -> np.ndarray:
    """By code point: letter, digit, white space (of ASCII), end mark or other."""
    out = np.zeros(0x110000, np.uint8)
    for i in range(0x40000):  # no letter or digit lies beyond
        c = unicodedata.category(chr(i))[0]
        if c == "L":
            out[i] = LETTER
        elif c == "N":
            out[i] = DIGIT
    out[[9, 10, 11, 12, 13, 32]] = SPACE
    out[[ord(c) for c in ".!?"]] = MARK
    return out


def part_of_speech(low: str) -> int:
    """Of a word of letters."""
    known = _BY_WORD.get(low)
    if known is not None:
        return known
    return P["ADV"] if low.endswith("ly") else P["VERB"] if low.endswith(_VERB) else P["ADJ"] if low.endswith(_ADJ) else P["NOUN"]


def lemma(low: str) -> str:
    n = len(low)
    if n > 5 and low.endswith("ing"):
        return low[:-3]
    if n > 4 and low.endswith("ed"):
        return low[:-2]
    return low[:-1] if n > 3 and low.endswith("s") and not low.endswith("ss") else low


def exact_round(x: np.ndarray, places: int = 2) -> np.ndarray:
    """functions.rounding.exact_round, operation by operation."""
    scale = 10.0**places
    high = x * 134217729.0 - (x * 134217729.0 - x)
    n = np.floor(x * scale)
    rest = (high * scale - n - 0.5) + (x - high) * scale
    return np.where(rest > 0, n + 1, np.where(rest < 0, n, np.where(n - 2 * np.floor(n / 2) == 0, n, n + 1))) / scale


def nullable(x: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.array(x, mask=~valid)


def ratio(n: np.ndarray, d: np.ndarray, otherwise: float = 0.0) -> np.ndarray:
    return np.divide(n, d, out=np.full(len(n), otherwise), where=d != 0, casting="unsafe")


def strings_at(joined: np.ndarray, starts: np.ndarray, ends: np.ndarray, kept: np.ndarray) -> pa.Array:
    """The pieces starts..ends, in order and together all the kept code points of joined."""
    points = joined[kept]
    data = points.tobytes().decode("utf-32-le").encode()
    at = np.concatenate([[0], np.cumsum(ends - starts)])
    if len(data) != len(points):
        width = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
        at = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[at]
    large = len(data) >= 1 << 31
    kind = pa.LargeStringArray if large else pa.StringArray
    return kind.from_buffers(len(starts), pa.py_buffer(at.astype(np.int64 if large else np.int32)), pa.py_buffer(data))


def joined_lists(offsets: np.ndarray, values: pa.Array, by: str) -> pa.Array:
    """Strings: the values of each list, joined."""
    values = values.cast(pa.string()) if values.type != pa.string() else values
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values), by)


def spans(keys: np.ndarray) -> np.ndarray:
    """Where the runs of equal keys begin, and the end."""
    return np.concatenate([np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


class Words:
    """The words of texts: what white space separates, in lower case. Each is met once, by Python's own dictionaries."""

    def __init__(self, texts: list[str]):
        self.words = [t.lower().split() for t in texts]

    def chunks(self, log_probs: list, size: int) -> dict:
        """As lm.chunk_log_probs with a unigram model, without overlap: doc, the texts, and the columns. log_probs: of each text's words."""
        out = {c: [] for c in ("doc", "chunk_id", "start_token", "end_token", "avg_log_prob", "num_tokens", "text_snippet")}
        for doc, (words, p) in enumerate(zip(self.words, log_probs, strict=True)):
            for at in range(0, len(words), size):
                part = p[at : at + size]
                for column, x in zip(out.values(), (doc, at // size, at, at + len(part), sum(part) / len(part), len(part), " ".join(words[at : at + min(size, 50)])), strict=True):
                    column.append(x)
        return out

    def commonest(self, most: int, least: int) -> list[str]:
        """Of each text, its commonest words of letters, as lexical.top_words, as word:freq."""
        out = []
        for words in self.words:
            # in order of first appearance, which sorting keeps among equals
            found = [(w, n) for w, n in Counter(words).items() if n >= least and w.isalpha()]
            out.append(",".join(f"{w}:{n}" for w, n in sorted(found, key=lambda x: -x[1])[:most]))
        return out


class Block:
    """Texts, annotated. t*: an entry for each token; s*: for each sentence."""

    def __init__(self, texts: list[str]):
        self.joined = "\n".join(texts)
        points = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts = np.cumsum(sizes + 1) - sizes - 1
        kind = kinds()[points]
        if len(texts) > 1:
            kind[starts[1:] - 1] = BETWEEN
        before = np.concatenate([[BETWEEN], kind[:-1]]).astype(np.uint8)
        after = np.concatenate([kind[1:], [BETWEEN]]).astype(np.uint8)
        run, single = (kind == LETTER) | (kind == DIGIT), (kind == OTHER) | (kind == MARK)
        begin, end = np.flatnonzero(single | (run & (kind != before))), np.flatnonzero(single | (run & (kind != after))) + 1
        # a sentence begins with a text, and at what follows end marks
        opens = (before == MARK) & (kind != MARK) & (kind != BETWEEN)
        opens[starts[sizes > 0]] = True
        opens = np.flatnonzero(opens)
        doc = np.searchsorted(starts, opens, "right") - 1
        closes = np.minimum(np.concatenate([opens[1:], [len(points)]]), (starts + sizes)[doc]) if len(opens) else opens
        first = np.searchsorted(begin, np.concatenate([opens, [len(points)]]))
        full = np.flatnonzero(first[1:] > first[:-1])
        self.opens, self.closes, self.sdoc = opens[full], closes[full], doc[full]
        self.first = np.concatenate([first[full], [len(begin)]])
        self.docs, self.n, self.m = len(texts), len(begin), len(full)
        self.sent = np.repeat(np.arange(self.m), np.diff(self.first))
        self.doc_first = np.searchsorted(self.sdoc, np.arange(self.docs + 1))
        self.sid = np.arange(self.m) - self.doc_first[self.sdoc]
        self.tdoc = self.sdoc[self.sent]
        self.tok_id = np.arange(self.n) - self.first[self.doc_first[self.tdoc]] if self.n else np.zeros(0, np.int64)
        self.kind = kind[begin]
        self.text = strings_at(points, begin, end, run | single)
        words = self.text.dictionary_encode()
        self.word, self.names = words.indices.to_numpy(), words.dictionary.to_pylist()
        self.lows = [w.lower() for w in self.names]
        self.alpha = self.kind == LETTER

    @cached_property
    def pos(self) -> np.ndarray:
        by_word = np.fromiter(map(part_of_speech, self.lows), np.int8, len(self.lows))
        return np.where(self.kind == LETTER, by_word[self.word], np.where(self.kind == DIGIT, P["NUM"], P["PUNCT"])).astype(np.int8)

    @cached_property
    def content(self) -> np.ndarray:
        return self.pos <= P["ADV"]

    def lowered(self, names: list[str]) -> tuple[np.ndarray, list[str]]:
        """Numbers of the distinct ones of names, by word, and these."""
        found = pa.array(names, pa.string()).dictionary_encode()
        return found.indices.to_numpy().astype(np.int64), found.dictionary.to_pylist()

    def counts(self, of: np.ndarray) -> np.ndarray:
        """Of each sentence, how many tokens."""
        return np.bincount(self.sent[of], minlength=self.m)

    @cached_property
    def tree(self) -> tuple[np.ndarray, np.ndarray]:
        """dep and head (a token of the block) of each token, by the annotator's rules."""
        n, pos, at, sent = self.n, self.pos, np.arange(self.n), self.sent
        low, high = self.first[:-1][sent], self.first[1:][sent]
        if not n:
            return np.zeros(0, np.int8), at

        def before(of):
            last = np.concatenate([[-1], np.maximum.accumulate(np.where(of, at, -1))[:-1]])
            return np.where(last >= low, last, -1)

        verbs, things = pos == P["VERB"], (pos == P["NOUN"]) | (pos == P["PRON"])
        root = np.full(self.m, n)
        for of in (verbs, pos == P["AUX"], pos != P["PUNCT"], np.ones(n, bool)):
            root = np.where(root == n, np.minimum.reduceat(np.where(of, at, n), self.first[:-1]), root)
        root = root[sent]
        verb, adp, full = before(verbs), before(pos == P["ADP"]), before((pos == P["NOUN"]) | verbs)
        following = np.minimum.accumulate(np.where(pos == P["NOUN"], at, n)[::-1])[::-1]
        noun = np.concatenate([following[1:], [n]])
        noun = np.where(noun < high, noun, -1)
        is_root, governed = at == root, (adp >= 0) & (full < adp)
        started = at == low
        last = np.where(started, -1, np.concatenate([[-1], pos[:-1]]))
        word = np.concatenate([[-1], self.word[:-1]])
        said = {w: np.array([x == w for x in self.lows] + [False])[np.where(started, -1, word)] for w in ("that", "to")}
        rank = [
            (is_root, "ROOT"), (verbs & (last == P["CCONJ"]), "conj"), (verbs & ((last == P["SCONJ"]) | said["that"]), "ccomp"), (verbs & said["to"], "xcomp"), (verbs, "advcl"),
            (things & governed, "pobj"), (things & (at < root), "nsubj"), (things, "dobj"),
            *((pos == P[p], d) for p, d in (("ADV", "advmod"), ("AUX", "aux"), ("CCONJ", "cc"), ("SCONJ", "mark"), ("PUNCT", "punct"), ("ADP", "prep"), ("DET", "det"), ("ADJ", "amod"), ("NUM", "nummod"))),
        ]
        dep = np.zeros(n, np.int8)
        for of, name in reversed(rank):
            dep[of] = D[name]
        or_root = lambda x: np.where(x >= 0, x, root)
        head = root.copy()
        for of, to in ((np.isin(pos, (P["DET"], P["ADJ"], P["NUM"])), or_root(noun)), (things, or_root(verb)), (things & (at < root), root), (things & governed, adp), (pos == P["ADP"], or_root(verb)), (is_root, at)):
            head = np.where(of, to, head)
        return dep, head

    @property
    def dep(self) -> np.ndarray:
        return self.tree[0]

    @property
    def head(self) -> np.ndarray:
        return self.tree[1]

    @cached_property
    def steps(self) -> list[np.ndarray]:
        """Each token's ancestors: itself, its head and so on to the root, where they stay. As many as the deepest token has; the rules give four steps at most."""
        out = [np.arange(self.n)]
        while self.n and (nearer := self.head[out[-1]]) is not None and (nearer != out[-1]).any():
            out.append(nearer)
        return out

    # what is told of sentences: name: (values, which are not null; None: all)

    def clauses(self) -> dict:
        dep = self.dep
        main, sub, co = self.counts(dep == D["ROOT"]), self.counts((dep >= D["ccomp"]) & (dep <= D["advcl"])), self.counts(dep == D["conj"])
        return {"main": main, "subordinate": sub, "coordinate": co, "subordination_ratio": exact_round(ratio(sub, main)), "coordination_ratio": exact_round(ratio(co, main))}

    def depth(self) -> dict:
        d = sum((b != a for a, b in zip(self.steps, self.steps[1:], strict=False)), np.zeros(self.n, np.int64))
        size, first = np.diff(self.first), self.first[:-1]
        most = int(d.max(initial=0)) + 1
        ordered = np.sort(self.sent * most + d) % most
        total = np.bincount(self.sent, d, self.m)
        middle = (ordered[first + (size - 1) // 2] + ordered[first + size // 2]) / 2
        return {"max_depth": ordered[first + size - 1].astype(np.int32), "mean_depth": total / size, "median_depth": middle, "depth_skew": total / size - middle}

    def dependency(self) -> dict:
        dep, head, at = self.dep, self.head, np.arange(self.n)
        arc = head != at
        n = np.bincount(head[arc], minlength=self.n)
        sub = (dep >= D["ccomp"]) & (dep <= D["advcl"])
        mean = lambda of: ratio(np.bincount(self.sent[of], n[of], self.m), self.counts(of))
        most = np.zeros(self.m, np.int64)
        heads = sub | (dep == D["ROOT"]) | (dep == D["conj"])
        if self.n:
            most = np.maximum.reduceat(np.where(heads, n, 0), self.first[:-1])
        far = np.bincount(self.sent, np.abs(head - at), self.m)
        return {"main_clause": mean(dep == D["ROOT"]), "subordinate_clause": mean(sub), "coordinate_clause": mean(dep == D["conj"]), "max_dependents": most, "mean_dependency_distance": ratio(far, self.counts(arc))}

    def density(self) -> dict:
        count, content = self.counts(self.kind_of_word), self.counts(self.content)
        return {"token_count": count, "content_count": content, "lexical_density": (ratio(content, count), count > 0)}

    @cached_property
    def kind_of_word(self) -> np.ndarray:
        return self.pos != P["PUNCT"]

    def cohesion(self) -> dict:
        number, names = self.lowered([lemma(x).lower() for x in self.lows])
        keys = np.sort(self.sent[self.alpha] * np.int64(len(names) + 1) + number[self.word[self.alpha]])
        keys = keys[spans(keys)[:-1]]
        # a lemma of the sentence before, as a key of this one
        moved = keys + (len(names) + 1)
        shared = moved[np.append(keys, -1)[np.searchsorted(keys, moved)] == moved]
        n = np.bincount(shared // (len(names) + 1), minlength=self.m)
        return {"cohesion_overlap": (n.astype(np.int32), self.sid > 0)}

    # freq: how often the corpus has each of the block's distinct words; 0 for what it hasn't

    def information(self, freq: np.ndarray) -> dict:
        seen = self.alpha & (freq[self.word] > 0)
        by_word = np.array([-math.log(f) if f else 0.0 for f in freq.tolist()])
        n = self.counts(seen)
        return {"information_content": (ratio(np.bincount(self.sent[seen], by_word[self.word[seen]], self.m), n), n > 0), "ic_count": n}

    def frequencies(self, freq: np.ndarray) -> pa.Array:
        """The frequencies behind information(), joined by commas."""
        seen = self.alpha & (freq[self.word] > 0)
        texts = pa.array(list(map(str, freq.tolist())), pa.string()).take(pa.array(self.word[seen]))
        return joined_lists(np.concatenate([[0], np.cumsum(self.counts(seen))]), texts, ",")

    def averages(self, freq: np.ndarray, overall: float | None) -> dict:
        """As lexical.average_word_frequency; overall: the mean frequency."""
        n, content = self.counts(self.alpha), self.counts(self.alpha & self.content)
        total = np.bincount(self.sent[self.alpha], np.maximum(freq, 1)[self.word[self.alpha]], self.m)
        mean, some = ratio(total, n), n > 0
        norm = exact_round(mean / overall, 3) if overall else np.zeros(self.m)
        return {"avg_word_freq": (exact_round(mean, 3), some), "normalized_freq": (norm, some), "content_function_ratio": (exact_round(ratio(content, n - content), 3), some)}

    def surprisal(self, freq: np.ndarray, mass: float | None, overall: float | None) -> dict:
        """As lm.surprisal; mass: of the counts, with one added for each word; overall: the mean of all tokens."""
        by_word = np.array([-math.log((f + 1) / mass) for f in freq.tolist()]) if mass else np.zeros(len(freq))
        sent, p = self.sent[self.alpha], by_word[self.word[self.alpha]]
        n = np.bincount(sent, minlength=self.m)
        mean = ratio(np.bincount(sent, p, self.m), n)
        spread = np.bincount(sent, (p - mean[sent]) ** 2, self.m)
        norm = mean / overall if overall else np.zeros(self.m)
        return {"mean_surprisal": exact_round(mean, 3), "surprisal_variance": exact_round(np.where(n > 1, ratio(spread, n - 1), 0), 3), "normalized_surprisal": exact_round(norm, 3)}

    def clause_heads(self) -> np.ndarray:
        """Which tokens are verbs that head a clause: the rules give every verb such a dependency."""
        return self.pos == P["VERB"]

    def _named(self, *deps: str) -> np.ndarray:
        """Tokens with one of these dependencies whose head is another token, a verb that heads a clause."""
        head = self.head
        return np.isin(self.dep, [D[d] for d in deps]) & (head != np.arange(self.n)) & self.clause_heads()[head]

    def roles(self) -> dict:
        heads = lambda *deps: self.counts(np.unique(self.head[self._named(*deps)]))
        return {"num_clauses": self.counts(self.clause_heads()), "num_agents": heads("nsubj"), "num_patients": heads("dobj", "pobj")}

    # tables

    def lemmas(self, at: np.ndarray | None = None) -> pa.Array:
        """Of the tokens at these places; of all."""
        return pa.array([lemma(x) for x in self.lows], pa.string()).take(pa.array(self.word if at is None else self.word[at]))

    def tokens(self) -> dict:
        dictionary = lambda codes, names: pa.DictionaryArray.from_arrays(pa.array(codes, pa.int8()), pa.array(names)).cast(pa.string())
        return {
            "sent_id": pa.array(self.sid[self.sent], pa.int32()), "tok_id": pa.array(self.tok_id, pa.int32()), "text": self.text.cast(pa.string()), "lemma": self.lemmas(), "pos": dictionary(self.pos, POS), "dep": dictionary(self.dep, DEP),
            "head_id": pa.array(self.tok_id[self.head], pa.int32()), "is_alpha": pa.array(self.alpha), "is_punct": pa.array(self.pos == P["PUNCT"]), "is_space": pa.array(np.zeros(self.n, bool)),
        }

    def sentence_texts(self) -> pa.Array:
        text = self.joined
        return pa.array([text[a:b] for a, b in zip(self.opens.tolist(), self.closes.tolist(), strict=True)], pa.string())

    def semantic_roles(self) -> dict:
        """The subjects and objects of each sentence, as role:text:head."""
        found = np.flatnonzero(np.isin(self.dep, (D["nsubj"], D["dobj"], D["pobj"])))
        dep = pa.array([DEP[d] for d in range(len(DEP))]).take(pa.array(self.dep[found]))
        said = pc.binary_join_element_wise(dep, self.text.take(pa.array(found)), self.text.take(pa.array(self.head[found])), ":")
        n = np.bincount(self.sent[found], minlength=self.m)
        return {"sentence_text": self.sentence_texts(), "roles": joined_lists(np.concatenate([[0], np.cumsum(n)]), said, ","), "role_count": pa.array(n)}

    def _subtrees(self, tops: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """The tokens of tops (a mask), in order, and the texts of their whole subtrees."""
        own, members, last = [], [], None
        for step in self.steps:
            of = tops[step] if last is None else tops[step] & (step != last)
            members.append(np.flatnonzero(of))
            own.append(step[of])
            last = step
        key = np.sort(np.concatenate(own) * np.int64(self.n or 1) + np.concatenate(members))
        top, member = key // (self.n or 1), key % (self.n or 1)
        offsets = spans(top)
        return top[offsets[:-1]], joined_lists(offsets, self.text.take(pa.array(member)), " ")

    def agents(self) -> tuple[np.ndarray, dict]:
        """Their tokens, and what is said of the clauses: level, predicate, agent, patient, all tokens."""
        verbs, subject, thing = self.clause_heads(), self._named("nsubj"), self._named("dobj", "pobj")
        top, said = self._subtrees(verbs | subject | thing)
        is_verb = verbs[top]
        at = top[is_verb]
        dep = self.dep[at]
        level = pa.array(["main", "coordinate", "subordinate"]).take(pa.array(np.where(dep == D["ROOT"], 0, np.where(dep == D["conj"], 1, 2))))

        def phrases(of: np.ndarray) -> pa.Array:
            which = np.flatnonzero(of[top])
            verb = self.head[top[which]]
            which = which[np.argsort(verb, kind="stable")]
            verb = np.sort(verb)
            offsets = spans(verb)
            texts = joined_lists(offsets, said.take(pa.array(which)), "; ")
            where = np.searchsorted(verb[offsets[:-1]], at)
            found = np.isin(at, verb)
            return texts.take(pa.array(where, mask=~found))

        return at, {"sent_id": pa.array(self.sid[self.sent[at]], pa.int32()), "tok_id": pa.array(self.tok_id[at], pa.int32()), "clause_level": level, "predicate": self.lemmas(at), "agent": phrases(subject), "patient": phrases(thing), "clause_tokens": said.filter(pa.array(is_verb))}

    def structures(self) -> dict:
        """The clauses of each sentence, as level:predicate, and the numbers of roles()."""
        at, table = self.agents()
        n = np.bincount(self.sent[at], minlength=self.m)
        said = pc.binary_join_element_wise(table["clause_level"], table["predicate"], ":")
        return {"clauses": joined_lists(np.concatenate([[0], np.cumsum(n)]), said, ",")} | {c: pa.array(v) for c, v in self.roles().items()}

    def phrases(self, stop_words: frozenset, top: int | None = None) -> tuple[np.ndarray, dict]:
        """(documents, phrase_idx, phrase, occurrences): as concepts.noun_phrases and, with top, concepts.top_phrases."""
        pos, at = self.pos, np.arange(self.n)
        inside = (pos == P["NOUN"]) | (pos == P["ADJ"]) | (pos == P["DET"]) | (pos == P["NUM"])
        opened = inside & ~np.where(at == self.first[:-1][self.sent], False, np.concatenate([[False], inside[:-1]])) if self.n else inside
        chunk = np.cumsum(opened) - 1
        nouns = np.bincount(chunk[inside & (pos == P["NOUN"])], minlength=int(chunk[-1]) + 1 if self.n else 0)
        words = [lemma(x).lower() for x in self.lows]
        fine = np.array([w not in stop_words for w in words], bool)
        kept = np.flatnonzero(inside)
        kept = kept[(nouns[chunk[kept]] > 0) & fine[self.word[kept]]] if len(kept) else kept
        offsets = spans(chunk[kept])
        first = kept[offsets[:-1]]
        said = joined_lists(offsets, pa.array(words, pa.string()).take(pa.array(self.word[kept])), " ").dictionary_encode()
        number, names = said.indices.to_numpy().astype(np.int64), said.dictionary
        # a lone word has letters alone; every phrase has an ASCII letter
        good = pc.match_substring_regex(names, "[A-Za-z]").to_numpy(zero_copy_only=False)[number] & ((np.diff(offsets) > 1) | self.alpha[first]) if len(number) else np.zeros(0, bool)
        number, first = number[good], first[good]
        keys, where, n = np.unique(self.tdoc[first] * np.int64(len(names) + 1) + number, return_index=True, return_counts=True)
        order = np.argsort(where, kind="stable")
        doc, number, n = keys[order] // (len(names) + 1), keys[order] % (len(names) + 1), n[order]
        idx = np.arange(len(doc)) - np.searchsorted(doc, doc)
        if top is not None:
            some = idx < top
            doc, number, n, idx = doc[some], number[some], n[some], idx[some]
        return doc, {"phrase_idx": pa.array(idx, pa.int32()), "phrase": names.take(pa.array(number)), "occurrences": pa.array(n, pa.int64())}

    # windows

    def tumbling(self, size: int, rows: dict, means: list[str], firsts: list[str] = (), some: list[str] = (), places: int = 2) -> tuple[np.ndarray, dict]:
        """operators.windows.tumbling of rows: the documents, and the columns."""
        opens = self.sid % size == 0
        window, at = np.cumsum(opens) - 1, np.flatnonzero(opens)
        last = np.concatenate([at[1:], [self.m]]) - 1 if len(at) else at
        out = {"window_id": pa.array(self.sid[at] // size, pa.int64()), "start_sentence": pa.array(self.sid[at], pa.int64()), "end_sentence": pa.array(self.sid[last], pa.int64())}
        for c in [*means, *some]:
            x, valid = rows[c] if isinstance(rows[c], tuple) else (rows[c], np.ones(self.m, bool))
            n = np.bincount(window[valid], minlength=len(at))
            # added in order
            total = np.bincount(window[valid], np.asarray(x, float)[valid], len(at))
            shown = n > 0 if c in means else (n > 0) & valid[at]
            out[c] = nullable(exact_round(ratio(total, n), places), shown)
        for c in firsts:
            x, valid = rows[c] if isinstance(rows[c], tuple) else (rows[c], np.ones(self.m, bool))
            out[c] = nullable(x[at], valid[at])
        return self.sdoc[at], out

    def frames(self, size: int) -> np.ndarray:
        """The sentences at which a full window of size sentences begins."""
        return np.flatnonzero(self.sid + size <= np.diff(self.doc_first)[self.sdoc]) if self.m else np.zeros(0, np.int64)

    def sliding(self, size: int, rows: dict, means: list[str], places: int = 2) -> tuple[np.ndarray, dict]:
        at = self.frames(size)
        out = {"start_sentence": pa.array(self.sid[at], pa.int64()), "end_sentence": pa.array(self.sid[at] + size - 1, pa.int64())}
        for c in means:
            x, valid = rows[c] if isinstance(rows[c], tuple) else (rows[c], np.ones(self.m, bool))
            total, n = np.zeros(len(at)), np.zeros(len(at), np.int64)
            for k in range(size):
                total, n = total + np.where(valid[at + k], x[at + k], 0), n + valid[at + k]
            out[c] = nullable(exact_round(ratio(total, n), places), n > 0)
        return self.sdoc[at], out

    def totals(self, size: int) -> tuple[np.ndarray, dict]:
        """Sums of roles() in each full window."""
        at = self.frames(size)
        rows = {c: np.concatenate([[0], np.cumsum(v)]) for c, v in self.roles().items()}
        return at, {f"total_{c[4:]}": v[at + size] - v[at] for c, v in rows.items()}

    def agent_windows(self, size: int) -> tuple[np.ndarray, dict]:
        at, sums = self.totals(size)
        texts = self.sentence_texts()
        sentences = pc.binary_join_element_wise(*[texts.take(pa.array(at + k)) for k in range(size)], "|")
        return self.sdoc[at], {"start_sentence": pa.array(self.sid[at], pa.int64()), "end_sentence": pa.array(self.sid[at] + size - 1, pa.int64())} | {c: pa.array(v) for c, v in sums.items()} | {"sentences": sentences}
