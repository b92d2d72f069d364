"""Text functions of the data path: word-level tokens, chat templates, placeholders, answers, names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BOS, EOS = "<s>", "</s>"


def words(text: Column) -> Column:
    """Runs of what is no white space; empty for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\S+"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(words(text)).cast("bigint")


def encode(text: Column, bos: bool = True, eos: bool = True) -> Column:
    """Word-level tokens with begin and end marks."""
    parts = [F.array(F.lit(BOS))] * bos + [words(text)] + [F.array(F.lit(EOS))] * eos
    return F.concat(*parts)


def decode(tokens: Column) -> Column:
    """The words without begin and end marks."""
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(BOS, EOS)), " ")


def is_blank(text: Column) -> Column:
    return F.coalesce(~text.rlike(r"\S"), F.lit(True))


def strip_newlines(text: Column) -> Column:
    """Without newlines at the end."""
    return F.regexp_replace(text, r"\n+$", "")


def ensure_eos(tokens: Column) -> Column:
    """EOS appended unless it is last already."""
    return F.when((F.size(tokens) == 0) | (F.try_element_at(tokens, F.lit(-1)) != EOS), F.concat(tokens, F.array(F.lit(EOS)))).otherwise(tokens)


def render_chat(messages: Column, generation_prompt: bool = False, bos: str = "", eos: str = "") -> Column:
    """Messages (array of role, content) through the template: role, newline, content and end mark of each; marks are empty unless given."""
    body = F.array_join(F.transform(messages, lambda m: F.concat(m["role"], F.lit("\n"), m["content"], F.lit(eos))), "")
    return F.concat(F.lit(bos), body, F.lit("assistant\n" if generation_prompt else ""))


def preview(text: Column, n: int = 300) -> Column:
    """The first n characters on one line."""
    return F.trim(F.translate(F.substring(text, 1, n), "\n", " "))


def placeholders(parts: Column, counts: Column, start: str, pad: str, end: str, eos: str = "") -> Column:
    """Joins text parts; the k-th null becomes start, counts[k] times pad, end. Stripped; eos is appended unless it ends so. Nulls beyond
    the counts make the result null."""
    zero = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, part: Column) -> Column:
        mark = F.concat(F.lit(start), F.repeat(F.lit(pad), F.try_element_at(counts, acc["k"] + 1).cast("int")), F.lit(end))
        return F.struct(F.concat(acc["s"], F.coalesce(part, mark)).alias("s"), (acc["k"] + F.when(part.isNull(), 1).otherwise(0)).alias("k"))

    out = F.trim(F.aggregate(parts, zero, step, lambda acc: acc["s"]))
    return F.when(F.lit(bool(eos)) & ~out.endswith(eos), F.concat(out, F.lit(eos))).otherwise(out)


def legacy_placeholders(text: Column, counts: Column, mark: str, start: str, pad: str, end: str, eos: str) -> Column:
    """The older form: the mark stands in the text, and eos is always appended."""
    pieces = F.split(text, mark)
    grown = F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.concat(F.lit(start), F.repeat(F.lit(pad), F.coalesce(F.try_element_at(counts, i + 1), F.lit(0)).cast("int")), F.lit(end))).otherwise(F.lit(""))))
    return F.concat(F.array_join(grown, ""), F.lit(eos))


#: How an answer is said, in the order in which they are tried; the last match of the first that matches counts. Fixed values.
ANSWER_TAG = r"\[ANSWER\]\s*(-?\d+)"
ANSWER_SAID = r"(?i)(?:the answer is|answer is|answer:)\s*(-?\d+)"
ANSWER_EQUALS = r"(?i)=\s*(-?\d+)\.?\s*(?:The answer|$)"
ANSWER_ANY = r"(-?\d+)"


def extract_answer(text: Column) -> Column:
    """The answer in a completion: tagged, said, after an equals sign, or else the last whole number; null without any."""
    last = lambda p: F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1))
    return F.coalesce(*map(last, (ANSWER_TAG, ANSWER_SAID, ANSWER_EQUALS, ANSWER_ANY))).cast("bigint")


def reward(completion: Column, expected: Column) -> Column:
    """1 if the answer is the expected one (empty: 0), else -1; 0.2 more for a right one with one tag and nothing after its number."""
    want = F.coalesce(F.when(expected != "", expected.cast("bigint")), F.lit(0).cast("bigint"))
    right = F.coalesce(extract_answer(completion) == want, F.lit(False))
    neat = (F.regexp_count(completion, F.lit(r"\[ANSWER\]")) == 1) & completion.rlike(r"\[ANSWER\]\s*-?\d+\s*$")
    return F.when(right & neat, 1.2).when(right, 1.0).otherwise(-1.0)


def split_reasoning(answer: Column, mark: str = "####") -> tuple[Column, Column]:
    """(reasoning, answer): what stands before and after the last mark, trimmed; raises without a mark."""
    have = F.when(answer.contains(mark), answer).otherwise(F.raise_error(F.concat(F.lit("no mark in: "), answer)))
    tail = F.substring_index(have, mark, -1)
    head = F.substring(have, F.lit(1), F.length(have) - F.length(tail) - len(mark))
    return F.trim(head), F.trim(tail)


def qa_messages(question: Column, answer: Column) -> Column:
    return F.array(F.struct(F.lit("user").alias("role"), question.alias("content")), F.struct(F.lit("assistant").alias("role"), answer.alias("content")))


def valid_messages(messages: Column) -> Column:
    """Exactly a user's and an assistant's message."""
    roles = F.transform(messages, lambda m: m["role"])
    return F.coalesce(F.array_join(roles, ",") == "user,assistant", F.lit(False))


def checked_messages(messages: Column) -> Column:
    """The same messages; raises unless they are valid."""
    return F.when(valid_messages(messages), messages).otherwise(F.raise_error(F.concat(F.lit("not user, assistant: "), F.array_join(F.transform(messages, lambda m: m["role"]), ","))))


def title_and_body(title: Column, body: Column) -> Column:
    return F.concat(title, F.lit("\n\n"), body)


def prompt(system: Column, question: Column) -> Column:
    return F.concat(system, F.lit("\n\n"), question)


def shard_name(path: Column) -> Column:
    """`dclm_g{g}_l{l}_s{stem}.jsonl` of a shard's path .../global-shard_{g}_of_../local-shard_{l}_of_../shard_{stem}_...."""
    part = lambda p: F.regexp_extract(path, p, 1)
    return F.concat(F.lit("dclm_g"), part(r"global-shard_(\d+)"), F.lit("_l"), part(r"local-shard_(\d+)"), F.lit("_s"), part(r"/shard_(\d+)"), F.lit(".jsonl"))


def step_of(name: Column, prefix: str = "global_step") -> Column:
    """The number after the prefix, anywhere in a directory's name; null without."""
    return F.nullif(F.regexp_extract(name, prefix + r"(\d+)", 1), F.lit("")).cast("bigint")


def first_pattern(name: Column, patterns: list[tuple[str, str]], default: str) -> Column:
    """The label of the first pattern found in name."""
    out = F.lit(default)
    for pattern, label in reversed(patterns):
        out = F.when(name.rlike(pattern), label).otherwise(out)
    return out


def padded(n: Column, width: int, before: str = "") -> Column:
    """Zero-padded; longer numbers are not cut."""
    return F.format_string(f"{before}%0{width}d", n)


def glob_pattern(glob: str) -> str:
    """The regular expression of a shell glob with * and ?, for a whole lower-cased name."""
    special = "\\.^$+{}[]()|"
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if c in special else c for c in glob.lower()) + "$"


def abstracted(name: Column) -> tuple[Column, Column]:
    """(name with each number in it put to {}, the numbers), for look-ups that do not depend on layer numbers."""
    return F.regexp_replace(name, r"\d+", "{}"), F.regexp_extract_all(name, F.lit(r"(\d+)"), F.lit(1))


def restored(pattern: Column, numbers: Column) -> Column:
    """Puts the numbers back for each {}."""
    pieces = F.split(pattern, r"\{\}")
    return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, F.when(i < F.size(pieces) - 1, F.coalesce(F.try_element_at(numbers, i + 1), F.lit(""))).otherwise(F.lit("")))), "")


#: Directives of strftime and their patterns. Fixed values.
DIRECTIVES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%b": "MMM", "%B": "MMMM", "%a": "EEE", "%A": "EEEE", "%y": "yy", "%I": "hh", "%p": "a", "%j": "DDD"}


def strftime(ts: Column | None, form: str) -> Column:
    """A time (now, in the session's zone, without one) in a strftime format; a directive that is not known raises."""
    ts = F.current_timestamp() if ts is None else ts
    parts = []
    for piece in re.findall(r"%.|[^%]+", form):
        if piece == "%%" or not piece.startswith("%"):
            parts.append(F.lit(piece.replace("%%", "%")))
        elif piece in DIRECTIVES:
            parts.append(F.date_format(ts, DIRECTIVES[piece]))
        else:
            raise ValueError(f"no such directive: {piece}")
    return F.concat(*parts) if parts else F.lit("")


#: Keys under which a configuration names special tokens. Fixed values.
SPECIAL_KEYS = ("bos_token", "eos_token", "unk_token", "sep_token", "pad_token", "cls_token", "mask_token")


def special_tokens(config: Column) -> Column:
    """map of SPECIAL_KEYS to tokens from a configuration's JSON, where a token is a string or an object with its content; absent ones are left out."""
    at = lambda k: F.coalesce(F.get_json_object(config, f"$.{k}.content"), F.get_json_object(config, f"$.{k}"))
    return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), at(k).alias("value")) for k in SPECIAL_KEYS]), lambda e: e["value"].isNotNull()))
