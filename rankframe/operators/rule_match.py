"""I1/C5 for large rule tables: all phrases of a table found in one pass over each text.

A rule is a row (rule_id, phrase, label, left, right): the phrase, in lower case, counts where it stands in
the lower-cased text; with ``left`` / ``right`` only where no ASCII letter or digit stands before / behind it.
Each task builds one Aho-Corasick automaton of the distinct phrases, so the time for a text is its length
plus its finds, however many rules there are (a column of one regular expression per rule reads the text
once for each).  The table is broadcast: MAX_RULES rows of MAX_PHRASE characters at most, checked.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 200_000
MAX_PHRASE = 256
RULES = "rule_id long, phrase string, label string, left boolean, right boolean"
_WORD = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")
_ALTERNATIVE = re.compile(r"\[([^\]]*)\]|(.)(\?)?")


def phrases_of(pattern: str) -> list[str]:
    """The phrases of one alternative of literals, ``x?`` and ``[xy]``: 'developers?' gives two, 'entry[- ]level' two."""
    parts = []
    for m in _ALTERNATIVE.finditer(pattern):
        parts.append(list(m.group(1)) if m.group(1) is not None else ["", m.group(2)] if m.group(3) else [m.group(2)])
    return ["".join(x) for x in itertools.product(*parts)]


def rules_of_patterns(spark: SparkSession, patterns: list[tuple[str, str]]) -> DataFrame:
    """A rule table from (pattern, label) pairs of the form ``(bound)(a|b|c)(bound)`` or ``(a|b|c)``, in their order."""
    rows = []
    for pattern, label in patterns:
        whole = re.fullmatch(r"(?P<l>\(\^\|\[\^a-z0-9\]\))?\((?P<alternatives>[^()]*)\)(?P<r>\(\[\^a-z0-9\]\|\$\))?", pattern)
        if not whole:
            raise ValueError(f"{pattern!r} is not a list of phrases")
        for one in whole["alternatives"].split("|"):
            rows += [(p, label, bool(whole["l"]), bool(whole["r"])) for p in phrases_of(one)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], RULES)


def match_rules(texts: DataFrame, rules: DataFrame, text_col: str, rules_out: str = "rule_ids", labels_out: str = "labels") -> DataFrame:
    """``texts`` with the ids of the rules found (ascending) and their distinct labels (in the order of their first rule).

    A null text has none.  Rules without a phrase never count; equal phrases of several rules count for each.
    """
    spark = texts.sparkSession
    known = rules.select(*[x.split()[0] for x in RULES.split(", ")]).filter(F.length("phrase") > 0).orderBy("rule_id").limit(MAX_RULES + 1).collect()
    if len(known) > MAX_RULES or any(len(r.phrase) > MAX_PHRASE for r in known):
        raise ValueError(f"a rule table holds at most {MAX_RULES} rules of {MAX_PHRASE} characters")
    shared = spark.sparkContext.broadcast([tuple(r) for r in known])
    names = [c for c in texts.columns if c not in (rules_out, labels_out)]
    given = texts.select(*[F.col(f"`{c}`") for c in names])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema]

    def run(frames):
        find, labels = _finder(shared.value)
        for pdf in frames:
            found = [find(t) if isinstance(t, str) else [] for t in pdf[text_col]]
            yield pdf.assign(**{rules_out: found, labels_out: [list(dict.fromkeys(labels[i] for i in x)) for x in found]})

    return given.mapInPandas(run, ", ".join([*kinds, f"`{rules_out}` array<bigint>", f"`{labels_out}` array<string>"]))


def _finder(rules: list[tuple]):
    """A function from a text to the ids of its rules, and the label of each id."""
    import ahocorasick
    by: dict[str, list] = {}
    for rule_id, phrase, _, left, right in rules:
        by.setdefault(phrase.lower(), []).append((rule_id, bool(left), bool(right)))
    automaton = ahocorasick.Automaton()
    for phrase, of in by.items():
        automaton.add_word(phrase, (len(phrase), of))
    if by:
        automaton.make_automaton()

    def find(text: str) -> list[int]:
        low, out = text.lower(), set()
        for end, (size, of) in automaton.iter(low) if by else ():
            inside_l, inside_r = end >= size and low[end - size] in _WORD, low[end + 1:end + 2] in _WORD
            out.update(i for i, left, right in of if not (left and inside_l) and not (right and inside_r))
        return sorted(out)
    return find, {r[0]: r[2] for r in rules}
