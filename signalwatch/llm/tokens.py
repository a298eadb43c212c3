"""Token ids of whole texts by a public tokenizer file, with a bounded memory of words per worker.

The word-level tokenizers of `tokenizers` here part words at white space before merging, so a text's ids are its words'
ids one after another. Words recur, so each worker keeps the ids of words it has met, in two generations of about
MEMORY_WORDS: when the younger is full it becomes the older, and words met again move to the younger, so common words
stay and rare ones go. Texts where a word's ids could depend on its neighbours go through the tokenizer whole. Results
never depend on the memory.
"""

from __future__ import annotations

import json
import os

import numpy as np

#: Words of a generation: about 150 bytes each.
MEMORY_WORDS = 400_000
#: Words that are encoded in one call.
CALL = 1024

_loaded: dict[str, object] = {}
_memory: dict[str, tuple[dict[str, bytes], dict[str, bytes]]] = {}
#: White space to Python's split() but not to the tokenizer.
_ODD = "\x1c\x1d\x1e\x1f"


def tokenizer(path: str):
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _loaded[path] = Tokenizer.from_file(path)
    return _loaded[path]


def plain_tokenizer(path: str):
    """The tokenizer without the steps that leave a lower-case word of Latin letters as it is: much the same merges at less cost. The whole one where its steps are others."""
    name = f"plain {path}"
    if name not in _loaded:
        from tokenizers import Tokenizer

        whole = tokenizer(path)
        parts = json.loads(whole.to_str())
        before, within = parts["normalizer"] or {}, parts["pre_tokenizer"] or {}
        steps = [x["type"] for x in before.get("normalizers", [before])]
        cuts = within.get("pretokenizers", [within])
        known = set(steps) <= {"NFC", "Replace", "Lowercase"} and [x.get("type") for x in cuts] == ["Split", "ByteLevel"] and r"[\p{L}]+" in str(cuts[0].get("pattern"))
        if known:
            parts["normalizer"], parts["pre_tokenizer"] = None, {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, cuts[1]]}
        _loaded[name] = Tokenizer.from_str(json.dumps(parts)) if known else whole
    return _loaded[name]


def _latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _encoded(words: list[str], path: str) -> dict[str, bytes]:
    """The ids of each word: many words in one call. Of words of letters only each is one piece, so pieces tell them apart; other tokens are placed by their characters."""
    out = {}
    for plain in (True, False):
        own, model = [w for w in words if w.isalpha() == plain], plain_tokenizer(path) if plain else tokenizer(path)
        for at in range(0, len(own), CALL):
            some = own[at : at + CALL]
            got = model.encode(" ".join(some), add_special_tokens=False)
            if plain:
                places, begins = np.array(got.word_ids, np.int64), np.arange(len(some) + 1)
            else:
                places, begins = np.array([a for a, _ in got.offsets], np.int64), np.concatenate(([0], np.cumsum([len(w) + 1 for w in some])))
            edges = (4 * np.searchsorted(places, begins)).tolist()
            raw = np.array(got.ids, "<u4").tobytes()
            out.update((w, raw[a:b]) for w, a, b in zip(some, edges[:-1], edges[1:], strict=True))
    return out


def _stopped(word: str) -> bool:
    """A comma or full stop after a letter or digit is a token of its own."""
    return word[-1] in ".," and word[-2:-1].isalnum()


def encode_words(texts: list[str], path: str) -> list[bytes]:
    """For each text its ids as little-endian unsigned 32-bit numbers, for a tokenizer that lower-cases and drops white space."""
    model = tokenizer(path)
    young, old = _memory.get(path, ({}, {}))
    if len(young) > MEMORY_WORDS:
        young, old = {}, young
    _memory[path] = young, old
    split = [None if "<|" in text or any(c in text for c in _ODD) or not _latin(text) else text.lower().split() for text in texts]
    missing = set().union(*(words for words in split if words)).difference(young)
    again = [w for w in missing if w in old]
    young.update((w, old[w]) for w in again)
    missing.difference_update(again)
    stopped = [w for w in missing if _stopped(w)]
    bases = {w for x in stopped for w in (x[:-1], x[-1])}.difference(young)
    known = _encoded(list(missing.difference(stopped) | bases), path)
    young.update(known)
    young.update((w, young[w[:-1]] + young[w[-1]]) for w in stopped)
    get = young.__getitem__
    return [b"".join(map(get, words)) if words is not None else np.array(model.encode(text, add_special_tokens=False).ids, "<u4").tobytes() for text, words in zip(texts, split, strict=True)]
