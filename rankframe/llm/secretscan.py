"""Secret scans: candidates by pattern, false positives removed by a random forest, in SQL functions alone.

Candidates are values given to a key word, passwords in addresses and long runs of key-like
characters, path parts each for itself; what of them is no secret, the forest removes.  The features of one are its length, character
transitions, dictionary coverage, path and neighbouring words, all column expressions; the forest's
trees are nested conditions over them.  Only the fit of the forest, on a bounded table of labelled
findings whose features the same expressions make, happens in numpy on the driver.
"""

from __future__ import annotations

import base64
import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankframe.llm.common import text_of

BEFORE, AFTER = 48, 16

# Words of the neighbourhood, of made-up secrets, and frequent letter pairs.
KEY_WORDS = "token|secret|passw|pwd|api.?key|auth(?!ors?\\b)|bearer|credential|private|access.?key|client.?id"
HARMLESS_WORDS = "commit|sha|md5|hash|checksum|digest|version|example|uuid|etag|revision|image|card|isbn|phone|mail|build|tag|blob"
DICTIONARY = ("password|example|sample|changeme|change|placeholder|dummy|test|your|token|secret|insert|here|default|admin|user|login|the|key|api|"
              "http|www|com|mail|file|path|name|data|value|true|false|null|none|this|with|from|release|version|build|lib|src|main|index")
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ch|ei|un|qu|ai|ie"
KNOWN = r"^(AKIA|ASIA|ghp_|gho_|ghs_|sk_live_|sk-|xox[abp]-|eyJ|AIza|glpat-)"

_QUOTE = "[\"'`]"
_GIVEN = rf"{_QUOTE}?\s{{0,3}}[=:]\s{{0,3}}{_QUOTE}?"
_PART = r"[A-Za-z0-9_+\-]"
#: A value of 6 characters or more after a key word and an assignment, without closing punctuation.
ASSIGNED = rf"(?<=[=:\s\"'`])(?<=[=:]\s{{0,3}}{_QUOTE}?)(?<=(?i:{KEY_WORDS})[A-Za-z0-9_\-]{{0,16}}{_GIVEN})[^\s\"'`<>]{{5,}}[^\s\"'`<>.,;:)\]}}]"
#: The password of ``scheme://user:password@host``.
USER_INFO = r"(?<=:)(?<=://[^\s/:@]{1,64}:)[^\s/@]{6,}(?=@)"
#: Base64 text with slashes that is no path.
BASE64 = r"(?<![A-Za-z0-9_+\-./:@])(?=[A-Za-z0-9+]{1,200}/)(?=[A-Za-z0-9+/]*?[0-9])[A-Za-z0-9+/]{32,}+={0,2}(?![A-Za-z0-9_+\-./])"
#: A run of 16 key-like characters or more with a digit or mixed case, or several such parts joined by dots.
RUN = rf"(?<!{_PART})(?={_PART}{{16}})(?=[A-Za-z_+\-]*+[0-9]|{_PART}*?[a-z][A-Z]{_PART}*?[a-z][A-Z]){_PART}{{16,}}+(?:\.{_PART}{{16,}}+)*+={{0,2}}"
CANDIDATE = f"{ASSIGNED}|{USER_INFO}|{BASE64}|{RUN}"

TREES, DEPTH, LABELLED, SEED = 15, 7, 2400, 5


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, nth, candidate, before, after, in text order: values given to key words, passwords in addresses, key-like runs."""
    cut = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    cut = cut.withColumn("runs", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).filter(F.size("runs") > 0)
    cut = cut.withColumn("pieces", F.split("text", CANDIDATE, -1))
    n = F.size("runs")
    each = F.arrays_zip(F.col("runs").alias("run"), F.slice("pieces", F.lit(1), n).alias("pre"), F.slice("pieces", F.lit(2), n).alias("post"))
    found = cut.select("id", F.posexplode(each).alias("nth", "f"))
    return found.select("id", F.col("nth").cast("long").alias("nth"), F.col("f.run").alias("candidate"),
                         F.right("f.pre", F.lit(BEFORE)).alias("before"), F.left("f.post", F.lit(AFTER)).alias("after"))


def feature_columns() -> dict[str, Column]:
    """The features of (candidate, before, after), by name."""
    c, low, before, after = F.col("candidate"), F.lower("candidate"), F.lower("before"), F.lower("after")
    n = F.length("candidate")

    def share(pattern: str, of: Column = c) -> Column:
        return F.regexp_count(of, F.lit(pattern)) / n

    def has(of: Column, pattern: str) -> Column:
        return of.rlike(pattern).cast("double")

    return {
        "length": n.cast("double"), "digits": share("[0-9]"), "upper": share("[A-Z]"), "lower": share("[a-z]"), "hex": share("[0-9a-f]", low),
        "switches": share(r"(?<=[a-z])(?![a-z])|(?<=[A-Z])(?![A-Z])|(?<=[0-9])(?![0-9])"),
        "pairs": share(f"(?=({PAIRS}))", low), "variety": F.size(F.array_distinct(F.split(c, ""))) / n,
        "dictionary": (n - F.length(F.regexp_replace(low, DICTIONARY, ""))) / n,
        "path": share(r"[/.\\]"), "in_path": has(before, r"[@/.:\\]$"), "goes_on": has(after, r"^[@:?&#/\\]"),
        "assigned": has(before, r"[=:]\s*[\"'`]?$"), "quoted": has(before, "[\"'`]$"),
        "key_word": has(before, KEY_WORDS), "harmless_word": has(before, HARMLESS_WORDS), "known": has(c, KNOWN),
        "symbols": share("[^A-Za-z0-9]"), "user_info": has(before, r"://[^\s/:@]{1,64}:$"), "variable": has(c, r"[${}()\[\]<>*]|\w\.[a-z]"),
    }


def with_features(found: DataFrame) -> DataFrame:
    made = {k: F.coalesce(v.cast("double"), F.lit(0.0)) for k, v in feature_columns().items()}
    return found.select("*", *[v.alias(f"f_{k}") for k, v in made.items()])


def labelled_findings(n: int = LABELLED, seed: int = SEED) -> list[dict]:
    """Findings with their label (1: a secret), built by rule: issued keys, and what merely looks like them."""
    r = random.Random(seed)
    syllables = "an be ci th he en in re on at ou le ti er ing ion que ra os sch ung".split()

    def letters(k: int, of: str) -> str:
        return "".join(r.choices(of, k=k))

    def words(k: int) -> str:
        return " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))

    hexes, alnum = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    issued = [lambda: letters(r.choice((32, 40, 40, 40, 64)), hexes), lambda: letters(r.choice((20, 24, 32, 40, 48)), alnum), lambda: letters(40, hexes).upper(),
              lambda: "AKIA" + letters(16, alnum[26:]), lambda: "ghp_" + letters(36, alnum), lambda: "sk_live_" + letters(24, alnum),
              lambda: "eyJ" + letters(60, alnum) + "." + letters(43, alnum), lambda: base64.b64encode(r.randbytes(r.choice((24, 30, 32)))).decode()]
    short = [lambda: words(1).capitalize() + str(r.randint(1950, 2030)) + letters(r.randint(0, 2), "!$#%"), lambda: letters(r.randint(8, 15), alnum), lambda: letters(r.choice((10, 12, 14)), hexes),
             lambda: letters(r.randint(7, 9), alnum) + r.choice("!@$%&?") + letters(r.randint(2, 12), alnum + "!@$#%"), lambda: words(1) + str(r.randint(1, 9)) + "!" + letters(r.randint(3, 5), alnum),
             lambda: letters(r.choice((24, 32, 40)), alnum[:26])]
    named = ["token", "secret", "password", "api_key", "apikey", "auth_token", "access_key", "client_secret", "TOKEN", "private_key"]
    given = [' = "', "='", ": ", '": "', "=", " = ", ": \""]
    fake = ["your_api_key_here_123", "xxxxxxxxxxxxxxxxxxxx1", "example-password-123", "changeme-changeme-1", "insert_token_here_0", "0000000000000000000", "test-token-value-1234",
            "dummy_secret_value_42", "sample.default.key.1", "1234567890123456", "aaaaaaaa11111111aaaa", "placeholder_token_99"]
    blanks = ["required", "optional", "string", "undefined", "${PASSWORD}", "${DB_TOKEN}", "process.env.TOKEN", "os.environ[X_KEY]", "********", "config.get(token)", "{{secret}}", "password", "changeme", "your-password", "self.token", "getToken()", "nullptr", "%(password)s"]
    plain = ["commit ", "sha256: ", "checksum ", "md5 = ", "digest: ", "etag: ", "revision ", "blob ", "image tag ", "build hash "]
    harmless = [lambda: (words(8) + " ", letters(16, "0123456789")), lambda: (words(3) + r.choice(".,") + f"{r.randint(1, 99)}@", f"mail{r.randint(1, 9)}.example.com"),
                lambda: (r.choice(plain), letters(r.choice((32, 40, 64)), hexes)), lambda: (words(3) + " " + r.choice(plain) + '"', letters(40, hexes)),
                lambda: (words(4) + " http://", "/".join([words(1) + ".example.com", "en", str(r.randint(1, 999)), words(1)])),
                lambda: (r.choice(named) + r.choice(given), r.choice(fake)), lambda: (words(5) + " /", "usr/lib/" + words(1) + f"/v{r.randint(1, 9)}.{r.randint(0, 20)}.{r.randint(0, 9)}/main.so"),
                lambda: (words(6) + " ", "".join(r.choices(syllables, k=7)) + f".{r.randint(1, 99)}"), lambda: (words(2) + " ", f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}T1{r.randint(0, 9)}.00.00"),
                lambda: ("uuid ", "-".join(letters(k, hexes) for k in (8, 4, 4, 4, 12))), lambda: (words(4) + " ", "version-" + ".".join(str(r.randint(0, 400)) for _ in range(5))),
                lambda: (words(2) + " " + r.choice(["author", "Author", "authors", "token", "tokens", "password", "secret", "auth", "pwd", "authority"]) + r.choice([": ", ": ", "=", " = "]), r.choice((str.lower, str.capitalize))("".join(r.choices(syllables, k=r.randint(3, 6))))),
                lambda: (r.choice(named) + r.choice(given), r.choice(blanks)), lambda: (words(2) + " http://www." + words(1).replace(" ", "") + ".org/20" + str(r.randint(10, 29)) + "/", "-".join("".join(r.choices(syllables, k=3)) for _ in range(3)) + f"-{r.randint(1, 2030)}")]
    out = []
    for i in range(n):
        if i % 2:
            before, candidate = words(r.randint(0, 5)) + " " + r.choice(named) + r.choice(given), r.choice(r.choice((issued, short)))()
            if i % 16 == 1:  # an address with a password
                before, candidate = words(r.randint(0, 5)) + f" {r.choice(('postgres', 'https', 'amqp', 'mysql'))}://{words(1).split()[0]}:", r.choice(short)().replace("@", "!")
            elif i % 16 == 3:  # a part of a path
                before, candidate = words(r.randint(0, 5)) + f" https://hooks.{words(1).split()[0]}.com/v{r.randint(1, 3)}/", letters(r.choice((24, 32, 40)), alnum)
        else:
            before, candidate = r.choice(harmless)()
        out.append({"candidate": candidate, "before": before[-BEFORE:], "after": ("@" if before.endswith(":") and "://" in before[-24:] else r.choice(('" ', '"', " ", "\n", "' ", ", ", ". "))) + words(1)[:8], "label": i % 2})
    return out


@dataclass
class Tree:
    """A leaf's share of secrets, or a question (feature <= cut) with the trees of either answer."""
    share: float
    feature: int = -1
    cut: float = 0.0
    below: Tree | None = None
    above: Tree | None = None

    def column(self, names: list[str]) -> Column:
        if self.feature < 0:
            return F.lit(self.share)
        return F.when(F.col(names[self.feature]) <= self.cut, self.below.column(names)).otherwise(self.above.column(names))


def grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int) -> Tree:
    """A tree on Gini impurity that looks at a random few features for each question."""
    share, best = float(y.mean()), (np.inf, -1, 0.0)
    if depth == 0 or len(y) < 4 or share in (0.0, 1.0):
        return Tree(share)
    for f in rng.choice(x.shape[1], int(np.ceil(np.sqrt(x.shape[1]))), replace=False):
        values = np.unique(x[:, f])
        cuts = (values[:-1] + values[1:]) / 2
        for cut in cuts if len(cuts) <= 24 else np.quantile(cuts, np.linspace(0, 1, 24)):
            side = x[:, f] <= cut
            n, a, b = side.sum(), y[side], y[~side]
            if 0 < n < len(y):
                impurity = n * a.mean() * (1 - a.mean()) + (len(y) - n) * b.mean() * (1 - b.mean())
                best = min(best, (impurity, int(f), float(cut)))
    if best[1] < 0:
        return Tree(share)
    side = x[:, best[1]] <= best[2]
    return Tree(share, best[1], best[2], grow(x[side], y[side], rng, depth - 1), grow(x[~side], y[~side], rng, depth - 1))


def train(spark: SparkSession, findings: list[dict] | None = None, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Tree]:
    """A forest on labelled findings (candidate, before, after, label); each tree sees a bootstrap sample of them."""
    findings = labelled_findings() if findings is None else findings
    kind = "array<struct<candidate:string,before:string,after:string,label:int>>"
    rows = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(findings)), kind)))
    made = with_features(rows).collect()
    names = [f"f_{k}" for k in feature_columns()]
    x, y = np.array([[m[k] for k in names] for m in made]), np.array([m["label"] for m in made], float)
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        forest.append(grow(x[pick], y[pick], rng, depth))
    return forest


def scan(docs: DataFrame, forest: list[Tree], id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per candidate: the id, nth (from 0 in text order), candidate, before, after, probability, secret.

    A candidate is a value of 6 characters or more that an assignment gives to a key word, the password of an
    address, or a run of 16 key-like characters or more with a digit or mixed case; ``nth`` has no gaps.  Null and empty texts have no candidates; repeated rows give repeated findings; an empty table
    gives no rows; other columns of ``docs`` are ignored.  The probability is the trees' mean share.
    """
    featured = with_features(candidates(docs, id_col, text_col))
    names = [f"f_{k}" for k in feature_columns()]
    votes = featured.select("id", "nth", "candidate", "before", "after", *[t.column(names).alias(f"v_{i}") for i, t in enumerate(forest)])
    mean = sum((F.col(f"v_{i}") for i in range(len(forest))), F.lit(0.0)) / max(len(forest), 1)
    return votes.select(F.col("id").alias(id_col), "nth", "candidate", "before", "after", mean.alias("probability")).withColumn("secret", F.col("probability") >= least)
