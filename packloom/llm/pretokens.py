"""Ids of texts as a tokenizers file gives them, with the merges run once per unknown word.

White space never reaches the merges of this kind of vocabulary (word ends are marked inside it),
so a text's ids are the ids of its white-space chunks one after the other, and a chunk's ids are
the ids of its pre-tokens.  That holds where normalising cannot reach over a chunk's edge, so only
*plain* chunks (printable ASCII and Latin-1, already composed) are taken apart here, and only their
pre-tokens go straight to the merges of the library; every other chunk goes to the library as it is.
"""

from __future__ import annotations

import json
import re

import numpy as np

from packloom.llm.common import memo_of

#: The file's own pre-token pattern for Latin-1, and its shape, which the shortcut relies on.
PRETOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
PLAIN_TEXT = re.compile(r"[\t\n\r\x20-\x7e\xa1-\xac\xae-\xff]*")
PLAIN_CHUNK = re.compile(r"[\x21-\x7e\xa1-\xac\xae-\xff]+")
EDGES = re.compile(r"[\t\n\r ]+")

#: Bounds of the memos a Python worker keeps: chunks, and pre-tokens that had to be merged.
CHUNKS = 600_000
MERGED = 600_000


def _byte_letters() -> dict[str, int]:
    """The letters in which byte-level vocabularies write bytes: printable ones stand for themselves."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def prove_whole_tokens(path: str) -> dict[str, bytes]:
    """The pre-tokens that the tokenizer encodes, alone, as one token, with that id.

    Every vocabulary string that ends a word is decoded and encoded by the library; those that
    come back as their own id are proved.  The result is bounded by the vocabulary.  A file of
    another shape proves nothing, and all its texts go to the library whole.
    """
    from tokenizers import Tokenizer

    if not splits_at_spaces(path):
        return {}
    library, letters, candidates = Tokenizer.from_file(path), _byte_letters(), {}
    for token, number in library.get_vocab(with_added_tokens=False).items():
        if token.endswith(WORD_END) and all(c in letters for c in token[: -len(WORD_END)]):
            try:
                word = bytes(letters[c] for c in token[: -len(WORD_END)]).decode()
            except UnicodeDecodeError:
                continue
            if PLAIN_CHUNK.fullmatch(word) and PRETOKEN.findall(word) == [word]:
                candidates[word] = number
    words = list(candidates)
    encoded = library.encode_batch(words, add_special_tokens=False)
    return {w: number_bytes([candidates[w]]) for w, e in zip(words, encoded, strict=True) if e.ids == [candidates[w]]}


def splits_at_spaces(path: str) -> bool:
    """Has the file the normaliser, pre-tokeniser and word ends that this module relies on?"""
    with open(path, encoding="utf-8") as file:
        content = json.load(file)
    normalizers = (content.get("normalizer") or {}).get("normalizers") or []
    split, *then = (content.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return (
        [n["type"] for n in normalizers] == ["NFC", "Replace", "Lowercase"]
        and [(t["type"], t["add_prefix_space"], t["use_regex"]) for t in then] == [("ByteLevel", False, False)]
        and content["model"].get("dropout") is None
        and split.get("pattern") == {"Regex": PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        and content["model"].get("end_of_word_suffix") == WORD_END and content.get("post_processor") is None
        and not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in content["added_tokens"]))


def number_bytes(ids) -> bytes:
    return np.asarray(ids, "<u4").tobytes()


class Pretokens:
    """Encodes texts; ``value`` turns the ids of a chunk (little-endian bytes) into what is kept for it."""

    def __init__(self, path: str, whole: dict[str, bytes], value=lambda ids: ids):
        from tokenizers import Tokenizer

        self.library, self.whole, self.value = Tokenizer.from_file(path), whole, value
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merges = self.library.model
        self.letters = {b: letter for letter, b in _byte_letters().items()}
        self.chunks, self.merged = {}, {}

    def values(self, texts: list[str | None]):
        """For each text the values of its chunks; a null text has none."""
        if not self.whole:
            yield from ([self.value(self._alone(text))] if text else [] for text in texts)
            return
        known = self.chunks
        for text in texts:
            if not text:
                yield []
                continue
            chunks = text.split() if PLAIN_TEXT.fullmatch(text) else [c for c in EDGES.split(text) if c]
            missing = set(chunks).difference(known)
            if missing:
                self._learn(missing)
            yield list(map(known.__getitem__, chunks))
            if len(known) > CHUNKS:
                known.clear()

    def _alone(self, text: str) -> bytes:
        return number_bytes(self.library.encode(text, add_special_tokens=False).ids)

    def _learn(self, chunks: set[str]) -> None:
        """Remember the chunks: most are one known pre-token, or one and a mark after it."""
        whole, merged, known, value = self.whole, self.merged, self.chunks, self.value
        parts, unknown = [], set()
        for chunk in chunks:
            lower = chunk.lower()
            if lower.isascii() and (lower.isalpha() or lower[-1] in ".," and lower[:-1].isalpha()):
                words = [lower] if lower.isalpha() else [lower[:-1], lower[-1]]
            elif not PLAIN_CHUNK.fullmatch(chunk) or any(s in chunk for s in self.special):
                known[chunk] = value(self._alone(chunk))
                continue
            else:
                words = PRETOKEN.findall(lower)
            ids = [whole.get(w) or merged.get(w) for w in words]
            if None in ids:
                parts.append((chunk, words))
                unknown.update([w for w, found in zip(words, ids, strict=True) if found is None])
            else:
                known[chunk] = value(ids[0] if len(ids) == 1 else b"".join(ids))
        self._merge(unknown)
        for chunk, words in parts:
            known[chunk] = value(b"".join([whole.get(w) or merged[w] for w in words]))
        if len(merged) > MERGED:
            merged.clear()

    def _merge(self, words: set[str]) -> None:
        """Merge unknown pre-tokens by the library's model, which takes them as they leave normaliser and pre-tokeniser: in letters for bytes."""
        tokenize, letters, ids, edges = self.merges.tokenize, self.letters, [], [0]
        for word in words:
            ids += [t.id for t in tokenize(word if word.isascii() else word.encode().decode("latin-1").translate(letters))]
            edges.append(4 * len(ids))
        flat = number_bytes(ids)
        self.merged.update(zip(words, map(flat.__getitem__, map(slice, edges, edges[1:])), strict=True))


def worker_pretokens(path: str, whole: dict[str, bytes], value=None) -> Pretokens:
    """The encoder of this Python worker, which tasks reuse."""
    kept = memo_of("pretokens")
    key = (path, value)
    if key not in kept:
        kept[key] = Pretokens(path, whole, *([value] if value else []))
    return kept[key]
