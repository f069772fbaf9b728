"""BPE encoding and decoding by a traversal of the words' prefix tree."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from clubspark.llm.common import each_text, texts

#: Bytes of encoded words that a Python worker keeps from batch to batch, beside the vocabulary's own tables.
CACHE = 96 << 20

#: What an entry of such a table takes beside its texts, and how many remembered pairs of tokens are kept.
ENTRY, PAIRS = 170, 300_000

#: Ids as they are kept.
IDS = np.dtype("<i4")

#: Symbols by which the tokens that may end at a place are looked up.
TAIL = 4

_ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Kept:
    """A table of bounded bytes: what is used stays, what was not used for as long as half the bytes took to come goes."""

    def __init__(self, most: int) -> None:
        self.most, self.size = most, 0
        self.new: dict = {}
        self.old: dict = {}

    def add(self, key: object, value: object, size: int) -> None:
        if self.size > self.most // 2:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += size + ENTRY

    def known(self, keys: set) -> dict:
        """Those of the keys that are here, which makes them used."""
        out = {key: self.new[key] for key in keys & self.new.keys()}
        for key in keys & self.old.keys():
            value = out[key] = self.old.pop(key)
            self.new[key] = value
            self.size += 2 * len(key) + ENTRY
        return out


class TrieEncoder:
    """Byte-pair encoding of whole words.

    Sorted distinct words are the depth-first order of their prefix tree.  The state of a node
    is the last token of the encoding of its prefix, and that encoding without its last token is
    the encoding of a shorter prefix, on the same path.  So one state per symbol is enough,
    prefixes that words share are worked out once, and a word is read off backwards.
    A token may follow another one if the merges of both together give just the two.
    """

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer

        model = json.loads(spec)
        library = Tokenizer.from_str(spec)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.end: str = model["model"]["end_of_word_suffix"] or ""
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["model"]["merges"])}
        #: Lengths above TAIL that a token may have by its last symbols; without and with the word end.
        self.lengths: tuple[dict[str, set[int]], dict[str, set[int]]] = ({}, {})
        for token in self.vocab:
            ended = bool(self.end) and token.endswith(self.end) and token != self.end
            body = token.removesuffix(self.end) if ended else token
            if len(body) > TAIL:
                self.lengths[ended].setdefault(body[-TAIL:], set()).add(len(body))
        self.split = {a + b: (a, b, rank) for (a, b), rank in self.ranks.items()}
        if len(self.split) < len(self.ranks):
            raise ValueError("two merges make the same token")
        self.names = {i: t for t, i in [*self.vocab.items(), *self.special.items()]}
        self.packed = {t: np.array([i], IDS).tobytes() for t, i in [*self.vocab.items(), *self.special.items()]}
        self.special_pattern = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self._follows: dict[str, dict[str, bool]] = {}
        self._pairs = 0
        self._tails: tuple[dict, dict] = ({}, {})
        self._symbols: dict[str, list[str]] = {}
        self._spines: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self._stable: dict[str, bool] = {}

    def symbols(self, token: str) -> list[str]:
        found = self._symbols.get(token)
        if found is None:
            ended = bool(self.end) and token.endswith(self.end) and len(token) > len(self.end)
            found = list(token[: -len(self.end)] if ended else token)
            if ended:
                found[-1] += self.end
            self._symbols[token] = found
        return found

    def merged(self, symbols: Iterable[str]) -> list[str]:
        """Plain byte-pair encoding: the best-ranked pair, leftmost first, until none is left."""
        parts = list(symbols)
        while len(parts) > 1:
            rank, at = min((self.ranks.get((a, b), len(self.ranks)), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == len(self.ranks):
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stable(self, token: str) -> bool:
        """Whether the token is the encoding of its own symbols."""
        found = self._stable.get(token)
        if found is None:
            found = self._stable[token] = self.merged(self.symbols(token)) == [token]
        return found

    def spine(self, token: str, side: int) -> list[tuple[str, float]]:
        """The parts that grow into the token at its left (0) or right (1) end, each with the rank of its next merge."""
        found = self._spines.get((token, side))
        if found is None:
            found, part, rank = [(token, float("inf"))], token, float("inf")
            while part in self.split:
                rank = self.split[part][2]
                part = self.split[part][side]
                found.append((part, rank))
            found.reverse()
            self._spines[token, side] = found
        return found

    def follows(self, before: str, token: str) -> bool:
        """Whether the two, side by side, are the encoding of their symbols.

        Parts grow on both sides of the border in the order of ranks; they stay apart if the pair
        across it never comes first.  Of equal ranks the leftmost merges first.
        """
        known = self._follows.setdefault(token, {})
        found = known.get(before)
        if found is None:
            found = self.stable(token) and (not before or self._apart(self.spine(before, 1), self.spine(token, 0)))
            known[before] = found
            self._pairs += 1
        return found

    def _ending(self, tail: str, ended: bool) -> tuple[tuple[int, ...], tuple[tuple[int, str, dict[str, bool]], ...]]:
        """What may end at a place with these last symbols: lengths of long tokens, and the short tokens, longest first.

        With each short token stand the tokens before it that are decided already.
        """
        end = self.end if ended else ""
        short = [(n, tail[-n:] + end) for n in range(len(tail), 0, -1) if tail[-n:] + end in self.vocab]
        found = tuple(sorted(self.lengths[ended].get(tail, ()), reverse=True)), tuple((n, t, self._follows.setdefault(t, {})) for n, t in short)
        self._tails[ended][tail] = found
        return found

    def _apart(self, left: list[tuple[str, float]], right: list[tuple[str, float]]) -> bool:
        i = j = 0
        while True:
            (a, after_a), (b, after_b) = left[i], right[j]
            rank = self.ranks.get((a, b))
            if rank is not None and rank < after_a and rank <= after_b:
                return False
            if after_a <= after_b:
                if i + 1 == len(left):
                    return True
                i += 1
            else:
                j += 1

    def encode_words(self, words: Iterable[str]) -> dict[str, list[str]]:
        """The tokens of each distinct word."""
        done: dict[str, list[str]] = {}
        if self._pairs >= PAIRS or sum(map(len, self._tails)) >= PAIRS // 2:
            self._pairs = 0
            self._follows, self._tails = {}, ({}, {})
        vocab, follows, end = self.vocab, self.follows, self.end
        last, before = [""], ""  # last[i]: the state of the prefix of i symbols on the current path
        for word in sorted(set(words)):
            shared, size = 0, len(word)
            most = min(len(before), size - 1, len(last) - 1)
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :]
            for at in range(shared + 1, size + 1):
                ended = at == size
                tail = word[at - TAIL : at] if at > TAIL else word[:at]
                long, short = self._tails[ended].get(tail) or self._ending(tail, ended)
                token = ""
                for length in long:
                    if length <= at:
                        longer = word[at - length : at] + end if ended else word[at - length : at]
                        if longer in vocab and follows(last[at - length], longer):
                            token = longer
                            break
                else:
                    for length, shorter, decided in short:
                        prior = last[at - length]
                        fits = decided.get(prior)
                        if fits or fits is None and follows(prior, shorter):
                            token = shorter
                            break
                if not token:
                    raise ValueError(f"no token ends {word[:at]!r}")
                last.append(token)
            token, at, tokens = last.pop(), size, []
            while token:
                tokens.append(token)
                at -= len(self.symbols(token))
                token = last[at]
            tokens.reverse()
            done[word] = tokens
            before = word
        return done

    def words(self, piece: str) -> list[str]:
        """Normalised words of a piece without special tokens, in the byte alphabet."""
        if piece.isascii() and piece.isprintable():
            return _ASCII_WORDS.findall(piece.lower())
        return [word for word, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(piece))]

    def parts(self, chunk: bytes) -> list[str]:
        """The words of a chunk without white space; special tokens are marked by a zero before them, which no word has."""
        text = chunk.decode("utf-8", "replace")
        if self.special_pattern is None or "<" not in text:
            return self.words(text)
        found: list[str] = []
        for piece in self.special_pattern.split(text):
            found += ["\0" + piece] if piece in self.special else self.words(piece)
        return found

    def encode_chunks(self, chunks: Iterable[bytes], words: Kept | None = None) -> dict[bytes, bytes]:
        """The packed ids of each chunk; words: those known already, to which new ones are added."""
        parts = {c: self.parts(c) for c in chunks}
        wanted = set().union(*parts.values())
        packed = self.packed
        known = {} if words is None else words.known(wanted)
        known |= {"\0" + special: packed[special] for special in self.special}
        for word, tokens in self.encode_words(wanted.difference(known)).items():
            ids = known[word] = b"".join([packed[t] for t in tokens])
            if words is not None:
                words.add(word, ids, len(word) + len(ids))
        return {c: known[found[0]] if len(found) == 1 else b"".join([known[w] for w in found]) for c, found in parts.items()}

    def encode(self, text: str) -> list[int]:
        chunks = text.encode().split()
        ids = self.encode_chunks(set(chunks))
        return np.frombuffer(b"".join([ids[c] for c in chunks]), IDS).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """The tokens' names joined by spaces, as the library does for a vocabulary without a decoder."""
        return " ".join(self.names[i] for i in ids if i in self.names)


#: Encoder and encoded words of the vocabulary a Python worker has used last; tasks that follow go on with it.
State = tuple[TrieEncoder, Kept, Kept]
_WORKER: dict[tuple[str, int], State] = {}


def worker_state(spec: str, cache: int) -> State:
    if (spec, cache) not in _WORKER:
        _WORKER.clear()
        _WORKER[spec, cache] = (TrieEncoder(spec), Kept(cache * 3 // 5), Kept(cache * 2 // 5))
    return _WORKER[spec, cache]


def _encode(shared, cache_size: int, outputs: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from clubspark.llm import bpe  # the module of the worker, whose state outlives the task

        encoder, cache, words = bpe.worker_state(shared.value, cache_size)
        names = pa.array([encoder.names.get(i, "") for i in range(max(encoder.names) + 1)], pa.string())
        gc.disable()  # caches of many small lists and no cycles: each collection would walk all of them
        try:
            for doc_ids, bodies in each_text(batches):
                yield encoded(doc_ids, bodies, encoder, names, cache, words)
        finally:
            gc.enable()

    def encoded(doc_ids, bodies, encoder, names, cache, words) -> pa.RecordBatch:
        split = [b.split() for b in bodies]
        wanted = set().union(*split)
        known = cache.known(wanted)
        fresh = encoder.encode_chunks(wanted.difference(known), words)
        for chunk, ids in fresh.items():
            cache.add(chunk, ids, len(chunk) + len(ids))
        known |= fresh
        packed = [b"".join(map(known.__getitem__, chunks)) for chunks in split]
        counts = [len(p) // IDS.itemsize for p in packed]
        offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32))
        ids = pa.array(np.frombuffer(b"".join(packed), IDS))
        decoded = pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(ids)), " ")
        if outputs:
            middle = pa.ListArray.from_arrays(offsets, ids)
        else:
            numbers = pc.binary_join(pa.ListArray.from_arrays(offsets, ids.cast(pa.string())), " ")
            middle, decoded = (
                pa.array([hashlib.sha256(t.as_buffer()).hexdigest() for t in column], pa.string()) for column in (numbers, decoded)
            )
        arrays = [doc_ids, pa.array(counts, pa.int64()), middle, decoded]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids", "decoded"])

    return run


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode(docs: DataFrame, vocabulary: str | None = None, digest: bool = False, cache: int = CACHE) -> DataFrame:
    """doc_id, n_tokens, ids (list of int) and decoded text of each row; with digest, their SHA-256 instead.

    vocabulary: path, on the driver, of a tokenizer file with a byte-level alphabet and a word end; its
    1.7 MB go to the executors as one broadcast value.  A null or empty text gives no tokens
    and an empty decoded text.  Repeated rows give repeated rows; an empty table an empty result; further columns are
    not looked at.  A worker holds ``cache`` bytes of encoded words, beside those of one batch;
    texts of any length are encoded whole, word by word.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    spec = docs.sparkSession.sparkContext.broadcast(Path(vocabulary or vocabulary_path()).read_text())
    ids = "string" if digest else "array<int>"
    found = texts(docs).mapInArrow(
        _encode(spec, cache, not digest), f"doc_id {kind}, n_tokens long, ids {ids}, decoded string"
    )
    return found.toDF("doc_id", "n_tokens", "ids_sha256", "decoded_sha256") if digest else found
