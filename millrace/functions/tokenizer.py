"""Library tokenizers: found in a folder on the driver, described by their configuration, and run in Arrow batches on the executors."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Configuration keys of special tokens. Fixed values.
SPECIAL_KEYS = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token")
#: Tokens that interleaved samples need, by role. Fixed values.
VISION_ROLES = ("image", "video", "vision_start", "vision_end", "pad")


def load(folder: str):
    """A tokenizer from what the folder holds: tokenizer.json; or a vocabulary (vocab.json before vocab.txt), as byte-level BPE with merges.txt and
    as a word list without. Raises with the files that are there."""
    from tokenizers import Tokenizer, decoders, models, pre_tokenizers, processors

    at = lambda name: os.path.join(folder, name)
    if os.path.exists(at("tokenizer.json")):
        return Tokenizer.from_file(at("tokenizer.json"))
    if os.path.exists(at("vocab.json")):
        with open(at("vocab.json"), encoding="utf-8") as f:
            vocab = json.load(f)
    elif os.path.exists(at("vocab.txt")):
        with open(at("vocab.txt"), encoding="utf-8") as f:
            vocab = {line.strip(): i for i, line in enumerate(f) if line.strip()}
    else:
        raise FileNotFoundError(f"no tokenizer in {folder}; it holds {sorted(os.listdir(folder)) if os.path.isdir(folder) else 'nothing'}")
    if not os.path.exists(at("merges.txt")):
        return Tokenizer(models.WordLevel(vocab=vocab, unk_token="[UNK]"))
    with open(at("merges.txt"), encoding="utf-8") as f:
        merges = [tuple(line.split()[:2]) for line in f if line.strip() and not line.startswith("#") and len(line.split()) > 1]
    out = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    out.pre_tokenizer, out.decoder, out.post_processor = pre_tokenizers.ByteLevel(add_prefix_space=False), decoders.ByteLevel(), processors.ByteLevel(trim_offsets=True)
    return out


def content(token: str | dict | None) -> str | None:
    """A token as configurations give it: a string, or an object with its content."""
    return token.get("content") if isinstance(token, dict) else token


def special_tokens(config: dict) -> dict[str, str]:
    """Special tokens by key, and added ones by id."""
    named = {k: content(config[k]) for k in SPECIAL_KEYS if content(config.get(k))}
    return named | {str(i): content(t) for i, t in (config.get("added_tokens_decoder") or {}).items() if content(t)}


#: Characters of texts, or ids, that go to the library at once: it holds some hundred bytes for each token, and for all texts of a call.
CALL = 1 << 16


def _calls(values: pa.Array, empty: str | list[int]) -> Iterator[list]:
    """A batch's values in runs of CALL elements at most; a longer one is a run of its own. Nulls are empty."""
    run, held = [], 0
    for value in values:
        x = value.as_py() or empty
        if run and held + len(x) > CALL:
            yield run
            run, held = [], 0
        run.append(x)
        held += len(x)
    if run:
        yield run


@dataclass
class Described:
    """A tokenizer with its marks: which it adds by itself (seen on the empty text), and which are added by default (as configured)."""

    tokenizer: object
    config: dict = field(default_factory=dict)

    def id_of(self, key: str) -> int | None:
        token = content(self.config.get(key))
        return self.tokenizer.token_to_id(token) if token else None

    def marks(self, add_bos: bool | None = None, add_eos: bool | None = None) -> tuple[list[int], list[int]]:
        """Ids to put before and after what the library gives."""
        own = self.tokenizer.encode("").ids
        out = []
        for key, wanted in (("bos_token", add_bos), ("eos_token", add_eos)):
            i = self.id_of(key)
            want = bool(self.config.get(f"add_{key}")) if wanted is None else wanted
            out.append([i] if want and i is not None and i not in own else [])
        return out[0], out[1]

    def encode(self, text: Column, add_bos: bool | None = None, add_eos: bool | None = None, length: int | None = None, pad: int = 0) -> Column:
        """Ids of a text column; with a length, clipped or padded to it. The tokenizer is sent once per task, as its own JSON."""
        spec, (before, after) = self.tokenizer.to_str(), self.marks(add_bos, add_eos)
        loaded: list = []

        @F.arrow_udf("array<int>")
        def run(values: pa.Array) -> pa.Array:
            from tokenizers import Tokenizer

            if not loaded:
                loaded.append(Tokenizer.from_str(spec))
            sizes, parts = [0], [np.zeros(0, np.int32)]
            for run in _calls(values, ""):
                ids = [before + e.ids + after for e in loaded[0].encode_batch_fast(run)]
                if length is not None:
                    ids = [(x + [pad] * (length - len(x)))[:length] for x in ids]
                sizes += [len(x) for x in ids]
                parts += [np.array(x, np.int32) for x in ids]
            return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), pa.array(np.concatenate(parts)))

        return run(text)

    def decode(self, ids: Column, skip_special: bool = True) -> Column:
        spec, loaded = self.tokenizer.to_str(), []

        @F.arrow_udf("string")
        def run(values: pa.Array) -> pa.Array:
            from tokenizers import Tokenizer

            if not loaded:
                loaded.append(Tokenizer.from_str(spec))
            # A run's strings go to Arrow before the next run is decoded.
            parts = [pa.array(loaded[0].decode_batch(run, skip_special_tokens=skip_special), pa.string()) for run in _calls(values, [])]
            return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

        return run(ids)

    def vision_ids(self, tokens: dict[str, str]) -> dict[str, int]:
        """Ids of the tokens by role; raises if one is not among the added tokens."""
        added = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        for role in VISION_ROLES:
            if tokens.get(role) not in added:
                raise ValueError(f"token {tokens.get(role)!r} ({role}) is not an added token; these are: {sorted(added)}")
        return {role: added[tokens[role]] for role in VISION_ROLES}


def dual(first: Column, second: Column) -> Column:
    """Two encoders' ids side by side."""
    return F.struct(first.alias("clip"), second.alias("t5"))
