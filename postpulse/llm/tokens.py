"""Token ids by the ``tokenizers`` library, memoised by chunk.

Byte-level pre-tokenizers of this family never let a token span a space and
what stands before it: a word takes at most the one space in front of it.  So
a text may be cut before every space that a non-space follows, and its ids are
the chunks' ids in order.  Words recur, so most chunks come from a memo and
only new ones go through the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postpulse.llm.common import map_batches, picked

#: Bytes of an id in files and checksums: little-endian unsigned 32-bit.
ID_BYTES = 4
#: Ends each document in the packed and the binary form.
END_ID = 0

_CUT = re.compile(r" (?=\S)")
#: Leading letters whose class every Unicode version agrees on, then the end or
#: an ASCII non-letter.
_WORD = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+(?=[\x00-@\[-`{-\x7f]|\Z)")


def _byte_letters() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, the rest for U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def cuttable(tokenizer: dict) -> bool:
    """Whether a tokenizer's texts may be cut before spaces: plain byte-level BPE, nothing around it.

    Added tokens are looked for in whole texts first, so none may hold a space.
    """
    before = tokenizer.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex") is True
    return (
        plain
        and not before.get("add_prefix_space")
        and not any(tokenizer.get(k) for k in ("normalizer", "truncation", "padding"))
        and (tokenizer.get("model") or {}).get("type") == "BPE"
        and not (tokenizer["model"].get("dropout") or tokenizer["model"].get("ignore_merges"))
        and not any(
            " " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"]
            for t in tokenizer.get("added_tokens") or ()
        )
    )


#: Bytes of a worker's memory that remembered chunks may take, and what each takes besides its characters.
MEMO_BYTES, ENTRY_BYTES = 224 << 20, 240


class ChunkEncoder:
    """Encodes texts to little-endian ids; remembered chunks take at most ``room`` bytes.

    A chunk that is new as a whole is cut once more after its leading letters:
    a run of letters is one pre-token and ends where they end.  Such a run goes
    to the library's model directly, anything else through its whole pipeline.
    """

    def __init__(self, path: str, room: int = MEMO_BYTES, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        if not cuttable(json.loads(self._tokenizer.to_str())):
            raise ValueError(f"{path}: chunks of its texts may not encode as the whole texts do")
        self._model = self._tokenizer.model
        self._words: dict[str, bytes] = {}
        self._parts: dict[str, bytes] = {}
        self._room, self._longest = room, longest
        size = self._tokenizer.get_vocab_size()
        self._id_bytes = [k.to_bytes(ID_BYTES, "little") for k in range(size)]
        letters = _byte_letters()
        self._space = letters[32]
        self._table = {
            k: "".join(letters[b] for b in chr(k).encode()) for k in range(128, 0x250)
        }

    def _library(self, chunk: str) -> bytes:
        ids = self._tokenizer.encode(chunk, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of letters that follow a space."""
        mapped = word if word.isascii() else word.translate(self._table)
        table = self._id_bytes
        return b"".join([table[t.id] for t in self._model.tokenize(self._space + mapped)])

    def encode(self, text: str) -> bytes:
        head, *rest = text.split(" ")
        known = list(map(self._words.get, rest))
        missing = [k for k, ids in enumerate(known) if ids is None]
        if any(not rest[k] or rest[k][0].isspace() for k in missing):
            head, *rest = _CUT.split(text)
            known = list(map(self._words.get, rest))
            missing = [k for k, ids in enumerate(known) if ids is None]
        for k in missing:
            known[k] = self._new(rest[k])
        first = self._library(head) if head else b""
        return first + b"".join(known)

    def _keep(self, memo: dict[str, bytes], chunk: str, ids: bytes) -> None:
        if self._room > 0 and len(chunk) <= self._longest:
            memo[chunk] = ids
            self._room -= ENTRY_BYTES + len(chunk) + len(ids)

    def _part(self, part: str, encode: Callable[[str], bytes]) -> bytes:
        ids = self._parts.get(part)
        if ids is None:
            ids = encode(part)
            self._keep(self._parts, part, ids)
        return ids

    def _new(self, chunk: str) -> bytes:
        """Ids of a chunk that follows a space."""
        found = _WORD.match(chunk)
        at = found.end() if found else 0
        word, tail = chunk[:at], chunk[at:] if at else f" {chunk}"
        ids = self._part(word, self._word) if word else b""
        if tail:
            ids += self._part(tail, self._library)
        self._keep(self._words, chunk, ids)
        return ids


_encoders: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One for each worker: its memo outlives a task, and goes when another vocabulary is asked for."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


#: How a byte-level tokenizer cuts texts before it merges bytes.
PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def check_ranks(path: str) -> None:
    """Raise unless ids are the ranks of merges, so that tiktoken merges as the tokenizer does.

    Ids of merged entries have to rise in the order of the merges, and every
    entry has to be what merging its own bytes leads to.
    """
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    content = json.loads(tokenizer.to_str())
    if not cuttable(content):
        raise ValueError(f"{path}: not a plain byte-level tokenizer")
    ids, special = content["model"]["vocab"], {t["content"] for t in content["added_tokens"]}
    merges = [m if isinstance(m, list) else m.split(" ") for m in content["model"]["merges"]]
    order = [ids[a + b] for a, b in merges]
    if order != sorted(order):
        raise ValueError(f"{path}: ids do not follow the order of merges")
    for entry, k in ids.items():
        if entry not in special and [t.id for t in tokenizer.model.tokenize(entry)] != [k]:
            raise ValueError(f"{path}: merges never lead to {entry!r}")


def ranked_encoder(path: str):
    """tiktoken's encoding of a tokenizer that ``check_ranks`` accepts; special tokens are plain text.

    It takes a seventh of the time of the library on words that are new.
    """
    import tiktoken
    from tokenizers import Tokenizer

    added = {t["content"] for t in json.loads(Tokenizer.from_file(path).to_str())["added_tokens"]}
    table, ids = byte_table(path), Tokenizer.from_file(path).get_vocab()
    ranks = {table[k]: k for entry, k in ids.items() if entry not in added}
    return tiktoken.Encoding("ranked", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})


def byte_table(path: str) -> list[bytes]:
    """The bytes that each id of a byte-level tokenizer stands for."""
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    letters = {letter: bytes([k]) for k, letter in enumerate(_byte_letters())}
    found = [b""] * (max(ids.values()) + 1)
    for entry, k in ids.items():
        found[k] = b"".join([letters.get(x) or x.encode() for x in entry])
    return found


def token_counts(
    df: DataFrame, tokenizer: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id and n_tokens (no end id) for each row; a null text has none."""
    path = tokenizer or default_tokenizer()
    rows = picked(df, doc_id=id_col, text=text_col)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        encode = encoder(path).encode
        counts = [len(encode(t)) // ID_BYTES if t else 0 for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(counts, type=pa.int64())], names=["doc_id", "n_tokens"]
        )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, work, f"doc_id {kind}, n_tokens long")
