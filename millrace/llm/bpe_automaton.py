"""Byte-level BPE as a deterministic automaton over tokens, built by one merge gadget after another.

The automaton starts with one state and a loop for each byte: every string of byte tokens is accepted.
The gadget of merge (u, v) -> t takes the state that u's arcs enter, copies it without its v arc, sends
u's arcs to the copy, and lets t run from wherever u ran to wherever v led. After the last gadget exactly
the token strings that BPE yields are accepted. What follows a token depends on that token alone, so a
state is named by the arc label that enters it, and the copies are kept as what each gadget removed and when;
a transition is worked out at its first use and then read from a table.

Encoding a pre-split word walks the arcs that spell it, the longest labels first. Decoding emits the arcs' labels.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm._common import hold

#: Fixed value: the byte-level pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: White-space runs stay with the word behind them: BPE never joins a character and the white space after it.
_CHUNK = re.compile(r"\s*\S+|\s+")
#: Python calls these white space; the pattern doesn't.
_ODD_SPACE = re.compile("[\x1c-\x1f]")

_NEVER = 1 << 60
CACHED_WORDS = 400_000
CACHED_ARCS = 2_000_000


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes: printable Latin-1 stands for itself, the rest for U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class TokenAutomaton:
    """The compiled automaton of a byte-level BPE vocabulary file (the tokenizers library's JSON)."""

    def __init__(self, spec: dict):
        model, alphabet = spec["model"], byte_alphabet()
        odd = [a for a in spec["added_tokens"] if a["single_word"] or a["lstrip"] or a["rstrip"]]
        if odd or spec["normalizer"] or model.get("ignore_merges") or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("only plain byte-level BPE without a normalizer is compiled")
        vocab = model["vocab"]
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self.label = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items() if s not in added}
        self.label |= {i: s.encode() for s, i in added.items()}
        self.added = added
        self.added_split = re.compile("(" + "|".join(sorted(map(re.escape, added), key=len, reverse=True)) + ")") if added else None
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        #: Gadget (u, v): the step at which the state behind u lost its v arc.
        self.removed: dict[tuple[int, int], int] = {}
        #: Label -> the labels it begins (ends) with, longest first, each with the step at which the next longer one came.
        self.starts: dict[int, tuple[tuple[int, int], ...]] = {}
        self.ends: dict[int, tuple[tuple[int, int], ...]] = {}
        self.arcs: dict[int, bool] = {}
        self.token = {}
        for c, b in alphabet.items():
            i = vocab[c]
            self.starts[i] = self.ends[i] = ((i, _NEVER),)
            self.token[bytes([b])] = i
        for step, (left, right) in enumerate(merges):
            u, v, t = vocab[left], vocab[right], vocab[left + right]
            if t in self.starts:
                raise ValueError(f"two merges make {left + right!r}")
            live = self._runs(u, v)
            self.starts[t] = ((t, _NEVER), (u, step), *((y, s) for y, s in self.starts[u][1:]))
            self.ends[t] = ((t, _NEVER), (v, step), *((y, s) for y, s in self.ends[v][1:]))
            if live:
                self.removed[u, v] = step
                self.token[self.label[t]] = t
        self.longest = max(map(len, self.token))
        self.written = {i: i.to_bytes(4, "little") for i in self.label}
        #: Ids of white-space chunks and of pre-split words met before; each is emptied at CACHED_WORDS entries.
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        import regex

        self.pattern = regex.compile(PATTERN)

    def _runs(self, u: int, x: int) -> bool:
        """Whether the state behind u has an arc x: no gadget took x, or a label x grew from, while it could.

        A gadget (u, u) takes the arc before it adds its own label, so its own step counts on the side of x.
        """
        removed = self.removed
        for w, w_until in self.ends[u]:
            for y, y_until in self.starts[x]:
                step = removed.get((w, y))
                if step is not None and step < w_until and step <= y_until:
                    return False
        return True

    def runs(self, u: int, x: int) -> bool:
        """The transition table, filled as it is used and emptied at CACHED_ARCS entries."""
        key = u << 32 | x
        found = self.arcs.get(key)
        if found is None:
            if len(self.arcs) >= CACHED_ARCS:
                self.arcs.clear()
            found = self.arcs[key] = self._runs(u, x)
        return found

    def encode_word(self, word: bytes) -> list[int]:
        """The one accepted token string that spells word: arcs are tried from the longest label down, and a place that
        leads nowhere is left for good, as each prefix has one accepted token string."""
        token, runs, label, n = self.token, self.runs, self.label, len(word)
        out, dead, at = [], set(), 0
        size = min(n, self.longest)
        while at < n:
            while size:
                t = token.get(word[at : at + size])
                if t is not None and (not out or runs(out[-1], t)) and at + size not in dead:
                    break
                size -= 1
            if size:
                out.append(t)
                at += size
            else:
                dead.add(at)
                size = len(label[out.pop()])
                at -= size
                size -= 1
                continue
            size = min(n - at, self.longest)
        return out

    def _chunk(self, chunk: str) -> bytes:
        pieces, written, out = self.pieces, self.written, []
        for word in self.pattern.findall(chunk):
            got = pieces.get(word)
            if got is None:
                got = b"".join([written[t] for t in self.encode_word(word.encode())])
                if len(word) <= 64:
                    if len(pieces) >= CACHED_WORDS:
                        pieces.clear()
                    pieces[word] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text, as little-endian unsigned 32-bit integers."""
        parts = self.added_split.split(text) if self.added_split else [text]
        out = []
        cache = self.words
        for k, part in enumerate(parts):
            if k % 2:
                out.append(self.added[part].to_bytes(4, "little"))
            elif _ODD_SPACE.search(part):
                out.append(self._chunk(part))
            else:
                for chunk in _CHUNK.findall(part):
                    got = cache.get(chunk)
                    if got is None:
                        got = self._chunk(chunk)
                        if len(chunk) <= 64:
                            if len(cache) >= CACHED_WORDS:
                                cache.clear()
                            cache[chunk] = got
                    out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        label = self.label
        return b"".join([label[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def _compiled(spec: str) -> TokenAutomaton:
    return TokenAutomaton(json.loads(spec))


def compile_file(path: str) -> TokenAutomaton:
    with open(path, encoding="utf-8") as f:
        return _compiled(f.read())


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """(doc_id, ids binary, decoded string) of every row, or digests: (doc_id, n_tokens, ids_sha256, decoded_sha256).

    vocabulary is the path of a byte-level BPE file, read on the driver and sent to the executors: its size is the
    vocabulary's, whatever the data. Null texts are empty; repeated rows are encoded each; an empty table gives
    an empty one; other columns are left out.
    """
    with open(vocabulary, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches):
        automaton = _compiled(spec.value)
        hold("bpe", _compiled.cache_clear)
        for batch in batches:
            ids = [automaton.encode(t or "") for t in batch.column(1).to_pylist()]
            texts = [automaton.decode(x) for x in ids]
            if digests:
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(ids, pa.binary()), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"]
                )

    rest = "n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "ids binary, decoded string"
    return docs.select(docs.doc_id.cast("long").alias("doc_id"), docs.text.cast("string").alias("text")).mapInArrow(run, f"doc_id long, {rest}")
