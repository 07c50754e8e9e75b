"""Quality rules as a bitmask ledger (DataFrame expressions only).

``measured`` takes each measurement once, ``ledger`` evaluates every rule once and stores the
failures as bits beside the measurements, ``apply_policy`` applies a versioned mask, and
``ablation`` answers "what would be kept without rule r" from the counts of distinct bitmasks,
without another look at the texts.

Defined results: a null text counts as empty; an empty text measures 0 everywhere and fails
``too_few_words``; a long text is measured whole, by its task alone; repeated rows get equal ledgers, and there are
no ties, as each row is judged by itself; an empty table gives an empty ledger. The ledger is one struct column,
which replaces an input column of the same name (``__ledger_*`` are names of its own).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import SPACES, SPLIT, clear_of

SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, bound as a lambda variable."""
    return F.transform(F.array(value), body).getItem(0)


def _covered(hashes: Column) -> Column:
    """Words in windows that occur twice or more: windows sorted by hash show equal neighbours, the
    positions of those, sorted, each cover up to the next one or their whole width."""

    def positions(s):
        twin = F.filter(s, lambda e, j: (e["h"] == F.get(s, j - 1)["h"]) | (e["h"] == F.get(s, j + 1)["h"]))
        return F.sort_array(F.transform(twin, lambda e: e["i"]))

    def words(p):
        widths = F.transform(p, lambda v, k: F.least(F.lit(WINDOW), F.coalesce(F.get(p, k + 1) - v, F.lit(WINDOW))))
        return F.aggregate(widths, F.lit(0), lambda a, x: a + x)

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(ordered, lambda s: let(positions(s), words))


def _repeat_words(words: Column) -> Column:
    def window(word, i):
        return F.xxhash64(word, *[F.get(words, i + k) for k in range(1, WINDOW)])

    windows = F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), window)
    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_covered(h)))
    return F.when(F.size(words) <= WINDOW, F.lit(0)).otherwise(counted)


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouts")


def measured(df: DataFrame, text: Column) -> DataFrame:
    """``df`` plus the parts of the measurements, ``__ledger_*``, each a column of its own, so that what follows names
    it as often as it likes without taking it again. Windows of words are compared by 64-bit hash."""
    text = F.coalesce(text, F.lit(""))

    def of_words(w):
        chars = F.length(F.array_join(w, ""))
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.cast("long").alias("word_chars"), _repeat_words(w).cast("long").alias("n_repeat_words"))

    def of_lines(lines):
        return F.struct(F.size(lines).cast("long").alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"))

    return df.select(
        "*",
        let(F.array_remove(F.split(text, SPLIT), ""), of_words).alias("__ledger_words"),
        let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != ""), of_lines).alias("__ledger_lines"),
        (F.size(F.split(text, SYMBOLS)) - 1).cast("long").alias("__ledger_symbols"),
        F.floor((F.length(text) - F.length(F.replace(text, F.lit("!!"), F.lit("")))) / 2).cast("long").alias("__ledger_shouts"),
    )


def _measure(name: str) -> Column:
    part = {"n_symbols": "symbols", "n_shouts": "shouts", "n_lines": "lines", "n_dup_lines": "lines"}.get(name, "words")
    found = F.col(f"__ledger_{part}")
    return found if part in ("symbols", "shouts") else found[name]


#: Rule name and the condition of failure over the measurements; the place in the list is the bit.
RULES = [
    ("too_few_words", lambda m: m["n_words"] < 10),
    ("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"]),
    ("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    ("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"])),
    ("shouting", lambda m: 2 * m["n_shouts"] > m["n_words"]),
    ("duplicate_lines", lambda m: 10 * m["n_dup_lines"] > 6 * m["n_lines"]),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}
BASE_MASK = BIT["too_few_words"] | BIT["repeated_windows"]

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ["too_few_words", "repeated_windows"],
    "v2": ["too_few_words", "repeated_windows", "symbols", "word_length", "shouting", "duplicate_lines"],
}
CURRENT = "v2"


def mask_of(policy: str | list[str]) -> int:
    return sum(BIT[r] for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def ledger(df: DataFrame, text_col: str = "text", out_col: str = "ledger") -> DataFrame:
    """``df`` plus one struct: the measurements and ``fail_bits``, every rule evaluated once."""
    rest = clear_of(df, [out_col]) if out_col.lower() != text_col.lower() else df
    m = {name: _measure(name) for name in MEASURES}
    bits = sum((F.when(fails(m), F.lit(1 << k)).otherwise(F.lit(0)) for k, (_, fails) in enumerate(RULES)), F.lit(0)).cast("long")
    found = F.struct(*[m[name].alias(name) for name in MEASURES], bits.alias("fail_bits"))
    keep = [F.col(f"`{c}`") for c in rest.columns if c.lower() != out_col.lower()]
    # as a generator's output: a filter on the bits isn't moved below it, where it would measure again
    return measured(rest, F.col(text_col)).select(*keep, F.explode(F.array(found)).alias(out_col))


def passes(policy: str | list[str], bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(mask_of(policy))) == 0


def apply_policy(ledgered: DataFrame, policy: str | list[str] = CURRENT, ledger_col: str = "ledger") -> DataFrame:
    """The rows that no rule of the policy rejects."""
    return ledgered.filter(passes(policy, F.col(ledger_col)["fail_bits"]))


def ablation(ledgered: DataFrame, policy: str | list[str] = CURRENT, ledger_col: str = "ledger") -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that only it rejects, and that the
    policy would keep without it. Works on the counts of distinct bitmasks, at most 2**rules rows."""
    mask = mask_of(policy)
    counts = ledgered.groupBy(F.col(ledger_col)["fail_bits"].alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    names = [n for n in BIT if BIT[n] & mask]
    rules = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.lit(BIT[n]).cast("long").alias("bit")) for n in names]))
    rows = counts.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", "r.bit")
    hit = rows["bits"].bitwiseAND(F.lit(mask))
    none = F.lit(0).cast("long")
    return rows.groupBy("rule").agg(
        F.sum(F.when(rows["bits"].bitwiseAND(rows["bit"]) != 0, rows["n"]).otherwise(none)).alias("n_failed"),
        F.sum(F.when(hit == rows["bit"], rows["n"]).otherwise(none)).alias("n_only_this"),
        F.sum(F.when(hit.bitwiseAND(F.bitwise_not(rows["bit"])) == 0, rows["n"]).otherwise(none)).alias("n_kept_without"),
    )
