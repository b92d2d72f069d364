"""Corpus filters as predicates, and their counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions import text as T


def passes(text: Column, *, min_tokens: int = 32, max_tokens: int = 0, lang_probs: Column | None = None, lang: str = "en", min_lang_prob: float = 0.5, quality: Column | None = None, min_quality: float | None = None) -> Column:
    """A text that is not blank, has enough words and not too many (0: any number), is likely enough of the language (skipped without a
    language, or where the probabilities are null), and is good enough (null passes)."""
    n = T.token_count(text)
    ok = text.isNotNull() & ~T.is_blank(text) & (n >= min_tokens)
    if max_tokens:
        ok = ok & (n <= max_tokens)
    if lang and lang_probs is not None:
        ok = ok & (lang_probs.isNull() | (F.coalesce(F.try_element_at(lang_probs, F.lit(lang)), F.lit(0.0)) >= min_lang_prob))
    if quality is not None and min_quality is not None:
        ok = ok & (quality.isNull() | (quality >= min_quality))
    return F.coalesce(ok, F.lit(False))


def counted(df: DataFrame, ok: Column, by: list[str]) -> DataFrame:
    """Rows written and skipped, by group."""
    return df.groupBy(*by).agg(F.count_if(ok).alias("written"), F.count_if(~ok).alias("skipped"))


def with_text(df: DataFrame, field: str = "text") -> DataFrame:
    return df.where(F.col(field).isNotNull() & (F.col(field) != ""))


def chat_fits(tokens: Column, length: int) -> Column:
    """Samples that need no truncation: their inputs are no longer than the window."""
    return F.size(tokens) - 1 <= length


def decoded(texts: Column, images: Column) -> Column:
    """An interleaved sample with as many images as texts, each place having one, and some text."""
    return F.coalesce((F.size(texts) == F.size(images)) & F.forall(F.arrays_zip(texts.alias("t"), images.alias("i")), lambda x: x["t"].isNotNull() | x["i"].isNotNull()) & (F.size(F.filter(texts, lambda t: t != "")) > 0), F.lit(False))


def interleaved(text: Column, image: Column) -> tuple[Column, Column]:
    """A pair in interleaved form: the image's place has no text, and the text's no image."""
    return F.array(F.lit(None).cast("string"), F.coalesce(text, F.lit(""))), F.array(image, F.lit(None).cast("string"))


def log_step(step: Column, freq: int) -> Column:
    return (step == 1) | (step % freq == 0)
