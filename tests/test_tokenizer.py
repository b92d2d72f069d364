"""Library tokenizers found in folders, their marks, and encoding in batches."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

tokenizers = pytest.importorskip("tokenizers")
from millrace.functions import tokenizer as K  # noqa: E402


def test_folders_are_tried_in_order(tmp_path):
    with pytest.raises(FileNotFoundError, match="no tokenizer"):
        K.load(str(tmp_path))
    (tmp_path / "vocab.txt").write_text("[UNK]\nhello\n\nworld\n")
    assert K.load(str(tmp_path)).token_to_id("world") == 3
    (tmp_path / "vocab.json").write_text(json.dumps({"a": 0, "b": 1, "ab": 2}))
    assert K.load(str(tmp_path)).token_to_id("world") is None
    (tmp_path / "merges.txt").write_text("#version\na b\n")
    assert K.load(str(tmp_path)).encode("ab").ids == [2]


def test_special_tokens():
    config = {"bos_token": "<s>", "eos_token": {"content": "</s>"}, "pad_token": None, "added_tokens_decoder": {"7": {"content": "<x>"}, "8": "<y>"}}
    assert K.special_tokens(config) == {"bos_token": "<s>", "eos_token": "</s>", "7": "<x>", "8": "<y>"}


def test_marks_are_added_once(spark):
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"<s>": 0, "</s>": 1, "a": 2, "b": 3, "[UNK]": 4}, unk_token="[UNK]"))
    t.pre_tokenizer = tokenizers.pre_tokenizers.Whitespace()
    d = K.Described(t, {"bos_token": "<s>", "eos_token": "</s>", "add_bos_token": True})
    df = spark.createDataFrame([("a b",), (None,)], "t string")
    assert [r[0] for r in df.select(d.encode(F.col("t"))).collect()] == [[0, 2, 3], [0]]
    assert [r[0] for r in df.select(d.encode(F.col("t"), add_bos=False, add_eos=True, length=4)).collect()] == [[2, 3, 1, 0], [1, 0, 0, 0]]
    assert df.select(d.decode(d.encode(F.col("t"), add_bos=False))).first()[0] == "a b"
    t.post_processor = tokenizers.processors.TemplateProcessing(single="<s> $A", special_tokens=[("<s>", 0)])
    assert d.marks(True, True) == ([], [1])  # the library adds the first by itself


def test_vision_tokens_must_be_there():
    t = tokenizers.Tokenizer(tokenizers.models.WordLevel({"[UNK]": 0}, unk_token="[UNK]"))
    t.add_special_tokens(["<i>", "<v>", "<s>", "<e>", "<p>"])
    names = dict(zip(K.VISION_ROLES, ("<i>", "<v>", "<s>", "<e>", "<p>"), strict=True))
    assert set(K.Described(t).vision_ids(names)) == set(K.VISION_ROLES)
    with pytest.raises(ValueError, match="video"):
        K.Described(t).vision_ids(names | {"video": "<none>"})
