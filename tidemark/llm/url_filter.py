"""URL filters: rules first, then logistic regression on hashed character n-grams of host and path."""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow

ALLOW, BLOCK = "allow", "block"
SIZES = (3, 4, 5)
FEATURES = 1 << 15
ROUNDS = 600
RATE = 0.3
PENALTY = 1e-6
DIGITS = str.maketrans("123456789", "000000000")

#: Words of hosts and paths that the default model learns to block, and to allow.
BLOCKED_WORDS = (
    "casino poker roulette slots jackpot lottery betting bets bookmaker gambling bingo blackjack "
    "porn xxx sex adult nude escort webcam erotic hentai camgirl "
    "ads adserver adclick banner popup tracker tracking affiliate clicks pixel sponsor retarget "
    "viagra cialis pills tramadol steroids slimming "
    "spam backlinks linkfarm clickbait doorway spammer "
    "phish malware warez keygen cracked trojan "
    "payday loans replica getrich pyramid"
).split()
ALLOWED_WORDS = (
    "garden library science history museum school physics algebra weather recipes kitchen travel music orchestra "
    "theatre cinema poetry novel grammar language dictionary atlas geography biology chemistry medicine nursing "
    "hospital anatomy astronomy robotics computer software manual compiler network database hardware archive press "
    "journal magazine newspaper reporter politics parliament council mayor village railway station airport bicycle "
    "sailing mountain forest river island harbour bakery cheese vineyard orchard farmers market crafts pottery "
    "painting sculpture gallery camera football tennis chess swimming marathon stadium university college campus "
    "lecture thesis research institute foundation charity church cathedral abbey castle heritage folklore genealogy "
    "adder adverb advice badge shadow leader reading better alphabet diabetes essex sussex"
).split()
#: What hosts and paths of both kinds are put together from.
HOST_STARTS = ("", "www.", "blog.", "m.", "news.", "shop.")
HOST_ADDED = ("{0}", "{0}-online", "my{0}", "{0}hub", "the-{0}", "{0}s", "best-{0}", "{0}24")
DOMAINS = ("example.com", "example.net", "example.org", "example.info")
PATHS = ("/", "/en/{1}", "/de/{1}/", "/fr/{1}.html", "/{0}/{1}", "/es/{1}", "/item/{1}", "/{0}.html")
#: Syllables of names that mean nothing, which are allowed.
SYLLABLES = "ba ce di fo gu ha je ki lo mu na pe ri so tu va we xi yo ze an er in on st th tr ble sh ou".split()
FORMS = 8
NAMES = 700


def labelled() -> list[tuple[str, str]]:
    """The labelled table that the default model is trained from: every word in some forms, and names that mean nothing. By rule, without a draw."""
    rows = []
    for verdict, words in ((BLOCK, BLOCKED_WORDS), (ALLOW, ALLOWED_WORDS)):
        for i, word in enumerate(words):
            for k in range(FORMS):
                n = i * FORMS + k
                host_ = HOST_STARTS[(i + 5 * k) % len(HOST_STARTS)] + HOST_ADDED[k].format(word) + "." + DOMAINS[(i + k) % len(DOMAINS)]
                rows.append((f"http://{host_}{PATHS[(3 * i + k) % len(PATHS)].format(word, n * 37 % 9973)}", verdict))
    for n in range(NAMES):
        name = "".join(SYLLABLES[n * (7 + 4 * j) // (1 + 3 * j) % len(SYLLABLES)] for j in range(2 + n % 3))
        rows.append((f"https://{HOST_STARTS[n % len(HOST_STARTS)]}{name}.{DOMAINS[n // 3 % len(DOMAINS)]}{PATHS[n // 2 % len(PATHS)].format(name, n * 53 % 9973)}", ALLOW))
    return rows


def host(url: str | Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(_part(url, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path(url: str | Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return _part(url, 2)


def _part(url: str | Column, group: int) -> Column:
    url = F.col(url) if isinstance(url, str) else url
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", group)


def ruled(host_: Column, path_: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule (verdict, host, path) that fits; nulls where none does.

    A rule fits its host and all subdomains if the path starts with the rule's. Of rules of one
    length the first by text wins. The rules are a short list from the configuration.
    """
    rule = verdict = F.lit(None).cast("string")
    for what, of_host, of_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host_ == of_host) | host_.endswith("." + of_host)) & path_.startswith(of_path)
        rule, verdict = F.when(fits, of_host + of_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def grams(host_: str, path_: str) -> np.ndarray:
    """The hashed character n-grams of host and path, each marked with where it is from; all digits count as one."""
    found = set()
    for mark, text in (("h", f"^{host_}$"), ("p", f"^{path_}$")):
        text = text.translate(DIGITS)
        for n in SIZES:
            found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode()) % FEATURES for i in range(max(1, len(text) - n + 1)))
    return np.fromiter(found, np.int64, len(found))


class Model:
    """Weights of the n-grams and a constant."""

    def __init__(self, weights: np.ndarray, constant: float):
        self.weights, self.constant = weights, constant

    def score(self, host_: str, path_: str) -> float:
        """The chance that the URL is one to block."""
        found = grams(host_, path_)
        return float(1 / (1 + np.exp(-(self.weights[found].sum() / np.sqrt(len(found)) + self.constant))))


def train(labelled: DataFrame, url_col: str = "url", label_col: str = "label", most: int = 10_000) -> Model:
    """Fit on a small labelled table (`allow` or `block`), of which the first `most` URLs in order are taken.

    Gradient descent over all rows from zero weights, with steps that shrink with each weight's own past gradients: the
    same table gives the same weights.
    """
    rows = labelled.where(F.col(label_col).isin(ALLOW, BLOCK)).select(host(url_col).alias("h"), path(url_col).alias("p"), F.col(label_col).alias("y"))
    rows = rows.orderBy("h", "p", "y").limit(most).collect()
    weights, constant = np.zeros(FEATURES), 0.0
    if not rows:
        return Model(weights, constant)
    found = [grams(r["h"], r["p"]) for r in rows]
    owner = np.repeat(np.arange(len(rows)), [len(f) for f in found])
    place, scale = np.concatenate(found), 1 / np.sqrt([len(f) for f in found])
    y = np.array([float(r["y"] == BLOCK) for r in rows])
    past, past_constant = np.full(FEATURES, 1e-8), 1e-8
    for _ in range(ROUNDS):
        z = np.bincount(owner, weights[place], len(rows)) * scale + constant
        off = 1 / (1 + np.exp(-z)) - y
        slope, slope_constant = np.bincount(place, (off * scale)[owner], FEATURES) / len(rows) + PENALTY * weights, off.mean()
        past, past_constant = past + slope**2, past_constant + slope_constant**2
        weights = weights - RATE * slope / np.sqrt(past)
        constant -= RATE * slope_constant / np.sqrt(past_constant)
    return Model(weights, constant)


def default_model(spark) -> Model:
    return train(spark.createDataFrame(labelled(), "url string, label string"))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """id, host, path, rule (null if none fits), verdict and score (chance to be one to block) of every row.

    The verdict is the rule's, else `block` where the score is over one half. A null URL, or one without
    ://, has an empty host and path. Repeated rows and null ids pass through; other columns are not read;
    an empty table gives no rows.
    """
    rows = pages.select(F.col(id_col).alias("_id"), host(url_col).alias("host"), path(url_col).alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = rows.select("_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict"))
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = rows.columns

    def scored(batch: pa.RecordBatch) -> dict:
        return dict(zip(names, batch.columns)) | {"score": [shared.value.score(h, p) for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]}

    done = map_arrow(rows, scored, rows.withColumn("score", F.lit(0.0)).schema)
    return done.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)).alias("verdict"), "score")
