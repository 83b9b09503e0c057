"""Chat messages, their rendering, and tokens."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config
from tidemark.functions.signals import col


def message(role: str | Column, content: Column) -> Column:
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"))


def to_messages(prompt: Column | str, response: Column | str, system: Column | None = None, messages: Column | None = None) -> Column:
    """`messages` if given, else a system turn (given, or the default), the prompt and the response, trimmed."""
    given = F.nullif(system, F.lit("")) if system is not None else F.lit(None).cast("string")
    trimmed = lambda c: F.trim(F.coalesce(col(c), F.lit("")))
    made = F.array(message("system", F.coalesce(given, F.lit(config.SYSTEM_TURN))), message("user", trimmed(prompt)), message("assistant", trimmed(response)))
    return F.coalesce(messages, made) if messages is not None else made


def render_template(messages: Column | str, generation_prompt: bool = False) -> Column:
    """Role-tagged blocks; a default system turn goes first if the first turn isn't one."""
    m = col(messages)
    block = lambda role, content: F.concat(F.lit(config.CHAT_START), role, F.lit("\n"), content, F.lit(config.CHAT_END + "\n"))
    default = block(F.lit("system"), F.lit(config.TEMPLATE_SYSTEM_TURN))
    head = F.when((F.size(m) > 0) & (F.get(m, 0)["role"] != "system"), default).otherwise("")
    tail = F.lit(config.CHAT_START + "assistant\n" if generation_prompt else "")
    return F.concat(head, F.array_join(F.transform(m, lambda x: block(x["role"], x["content"])), ""), tail)


def render_plain(messages: Column | str) -> Column:
    """`ROLE: content` lines, for tokenizers without a template."""
    return F.array_join(F.transform(col(messages), lambda x: F.concat(F.upper(F.coalesce(x["role"], F.lit("user"))), F.lit(": "), F.coalesce(x["content"], F.lit("")))), "\n")


def whitespace_tokens(text: Column | str, most: int = config.DEFAULTS.max_tokens) -> Column:
    """The first tokens between runs of white space."""
    words = F.filter(F.split(col(text), r"[ \t\n\r\f\x0B]+"), lambda w: w != "")
    return F.slice(words, 1, most)


def tokenizer_udf(path: str, most: int = config.DEFAULTS.max_tokens):
    """A batched Pandas UDF over a tokenizers file: ids, truncated, without padding."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.enable_truncation(most)
        for texts in batches:
            yield pd.Series([e.ids for e in tokenizer.encode_batch(texts.fillna("").tolist())])

    return run
