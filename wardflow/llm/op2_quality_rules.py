"""Quality rules as a short-circuit cascade, ordered by what a rule rejects per second it costs.

Each rule's cost and share of rejections are measured on a sample of the table; the cascade then
runs the rules in falling order of rejections per second and stops at the first that rejects. The
order changes the time only: a text is kept if no rule rejects it, whichever comes first.

Defined results: NULL or empty text has no words and is rejected by ``few_words``; repeated rows are
judged one by one, each like the others; an empty table gives no rows; texts are read whole; columns
of the input other than the id and the text are left as they are.
"""

from __future__ import annotations

import re
import time
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")
# The characters that count as symbols.
SYMBOLS = "#*$%&|<>"


class Facts:
    """What rules ask about a text, each worked out when first asked for."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[str]:
        return WORD.findall(self.text)

    @property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return sum(map(len, self.words))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def lines(self) -> list[str]:
        return [line for line in self.text.split("\n") if WORD.search(line)]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that the text has at least twice."""
        words = self.words
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) == len(windows):
            return 0
        times = Counter(windows)
        covered = end = 0
        for i, window in enumerate(windows):
            if times[window] > 1:
                covered += i + 3 - max(i, end)
                end = i + 3
        return covered


@dataclass(frozen=True)
class Rule:
    name: str
    rejects: Callable[[Facts], bool]


def few_words(facts: Facts) -> bool:
    return facts.n_words < 50


def repeated_words(facts: Facts) -> bool:
    return 100 * facts.n_repeat_words > 50 * facts.n_words


def many_symbols(facts: Facts) -> bool:
    return 5 * facts.n_symbols > facts.n_words


def repeated_lines(facts: Facts) -> bool:
    return 2 * facts.n_dup_lines > len(facts.lines)


def odd_word_length(facts: Facts) -> bool:
    return facts.word_chars < 2 * facts.n_words or facts.word_chars > 12 * facts.n_words


BASE_RULES = (Rule("few_words", few_words), Rule("repeated_words", repeated_words))
RULES = (
    *BASE_RULES,
    Rule("many_symbols", many_symbols),
    Rule("repeated_lines", repeated_lines),
    Rule("odd_word_length", odd_word_length),
)


def measure_rules(docs: DataFrame, rules: Sequence[Rule], text: str = "text", sample_rows: int = 2000) -> list[tuple]:
    """(rule, texts, rejections, seconds) on about ``sample_rows`` rows picked by the hash of the text's start."""
    rules = tuple(rules)
    share = min(1.0, sample_rows / max(1, docs.count()))
    picked = F.pmod(F.xxhash64(F.substring(F.col(text), 1, 100)), F.lit(1_000_000)) < int(share * 1_000_000) + 1

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            rows = []
            for rule in rules:
                start = time.perf_counter()
                rejected = sum(rule.rejects(Facts(x)) for x in texts)
                rows.append({"rule": rule.name, "n": len(texts), "rejected": rejected, "s": time.perf_counter() - start})
            yield pa.RecordBatch.from_pylist(rows)

    measured = docs.select(F.col(text).cast("string").alias(text)).where(picked).mapInArrow(
        measure, "rule string, n long, rejected long, s double"
    )
    return [tuple(x) for x in measured.groupBy("rule").agg(F.sum("n"), F.sum("rejected"), F.sum("s")).collect()]


def order_rules(rules: Sequence[Rule], measured: Sequence[tuple]) -> tuple[Rule, ...]:
    """Rules by rejections per second, the best first; rules that reject nothing by their cost."""
    gain = {name: (rejected / max(s, 1e-9), -s) for name, _, rejected, s in measured}
    return tuple(sorted(rules, key=lambda rule: gain.get(rule.name, (0.0, 0.0)), reverse=True))


def first_rejection(facts: Facts, cascade: Sequence[Rule]) -> str | None:
    return next((rule.name for rule in cascade if rule.rejects(facts)), None)


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = 2000) -> DataFrame:
    """The rows no rule rejects, with their columns as they were."""
    cascade = order_rules(rules, measure_rules(docs, rules, text, sample_rows))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            yield batch.filter(pa.array([first_rejection(Facts(x), cascade) is None for x in texts], pa.bool_()))

    return docs.mapInArrow(passed, docs.schema)


_MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): the base measures, base_failed, kept and the rejecting rule."""
    cascade = order_rules(rules, measure_rules(docs, rules, "text", sample_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                facts = Facts(text)
                failed = any(rule.rejects(facts) for rule in BASE_RULES)
                by = first_rejection(facts, cascade)
                rows.append((*(getattr(facts, x) for x in _MEASURES), failed, by is None and not failed, by))
            columns = list(zip(*rows)) if rows else [()] * (len(_MEASURES) + 3)
            kinds = [*[pa.int64()] * len(_MEASURES), pa.bool_(), pa.bool_(), pa.string()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, columns, kinds)],
                ["doc_id", *_MEASURES, "base_failed", "kept", "rejected_by"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    measures = ", ".join(f"{x} long" for x in _MEASURES)
    return rows.mapInArrow(run, f"doc_id long, {measures}, base_failed boolean, kept boolean, rejected_by string")


# What `kept` means, over the columns of `facts`.
RULES_SQL = """
    n_words >= 50 AND 100 * n_repeat_words <= 50 * n_words AND 5 * n_symbols <= n_words
    AND 2 * n_dup_lines <= n_lines AND word_chars BETWEEN 2 * n_words AND 12 * n_words
"""

FACTS_SQL = r"""
    words AS (
        SELECT doc_id, coalesce(text, '') AS text,
               regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
        FROM documents
    ), windows AS (
        SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM words)
    ), twice AS (
        SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows) WHERE n > 1
    ), covered AS (
        SELECT doc_id, count(DISTINCT place) AS n_repeat_words
        FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS place FROM twice) GROUP BY doc_id
    ), facts AS (
        SELECT doc_id, len(ws) AS n_words,
               coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
               len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
               len(list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]'))) AS n_lines,
               n_lines - len(list_distinct(list_filter(string_split(text, chr(10)),
                   lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
               coalesce(n_repeat_words, 0) AS n_repeat_words
        FROM words LEFT JOIN covered USING (doc_id)
    )
"""

# Only for tables whose doc_id is unique. Which rule rejects depends on measured costs, so the query leaves it out.
JUDGE_SQL = f"""
    WITH {FACTS_SQL}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
           {RULES_SQL} AS kept
    FROM facts
"""
