"""URL filter: logistic regression on hashed character n-grams of host and path, under host rules.

The training table is made by rule from short word lists: eight unwanted themes and plain subjects, put
together to host names and paths in several patterns. Words that the two share (free, best, club) and plain
words that hold an unwanted one's letters (roads, diabetes, essex) stand on either side, so the weights have
to come from the theme. A quarter of the host names, with all their URLs, is held out and never trained on.

The verdict's threshold is calibrated on words that the scoring model has not seen: the rows are cut in two by the
word behind the host name, each half is scored by the other's model, and the bias is moved until at most
``FALSE_BLOCKS`` of the plain rows would be blocked.
"""

from __future__ import annotations

import functools
import math
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from panelmill.llm.common import map_batches, table

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
BUCKETS = 1 << 14
SIZES = (3, 4, 5)
_THEMES = {
    "gambling": "casino poker slots betting bet jackpot roulette bingo lotto blackjack wager gamble",
    "medicine": "pills viagra cialis pharma tablets steroids painkiller rx dietpill botox",
    "adult": "adult porn xxx sex nude escort webcam erotic milf camgirls",
    "spam": "spam backlinks linkfarm seo bulkmail clickbait doorway autopost",
    "adverts": "ads adserver popunder banner tracker track pixel affiliate clicks adnet",
    "loans": "payday loan loans cashadvance quickcash debt forex getrich",
    "piracy": "torrent warez crack keygen nulled cracked serials pirate",
    "malware": "phish malware trojan exploit botnet virus hack keylogger",
}
_PLAIN = "library news science garden music school history travel recipes museum weather river city health sports kitchen books law poetry art film theatre chess hiking bakery farm forest birds astronomy physics maths language football cycling sailing knitting pottery photo gallery market council church village harbour bridge college teacher parents nature ocean mountain"
_EVERYDAY = "times post herald tribune gazette journal pharmacy hospital clinic dentist medical nurse advent easter christmas credit union bank insurance savings mortgage rental estate lawyer court police army navy airport railway train bus taxi hotel hostel resort cruise beach island castle palace park zoo aquarium puppy kitten horse cattle dairy cheese coffee tea wine brewery pasta bread butter pepper spice grocery market fashion shoes jewelry furniture carpet paint plumbing roofing engine motor tyre bicycle tennis golf rugby hockey swimming yoga fitness marathon guitar piano violin orchestra opera ballet dance drama comedy cartoon novel essay grammar dictionary atlas globe planet galaxy telescope rocket robot laser chemistry biology geology fossil dinosaur insect butterfly orchid cactus tulip timber quarry copper silver diamond textile cotton woollen leather ceramic glass mirror candle lantern battery solar wind turbine"
_TRAPS = "roads uploads headset saddle analysis essex sussex middlesex alphabet diabetes tibet better spillway pillow caterpillar railtrack soundtrack pokerface slotcar therapist adulthood seoul museo barxes craftclicks loaner debtor hackney crackers virusology pixelart bannerman"
_SHARED = "free best online hot top fast super easy my the club shop zone world daily big new"
_ENDS = ("example.com", "example.net", "example.org", "com", "net", "org", "info", "co.uk")
_PREFIXES = ("", "", "www.", "m.", "blog.")
_PATHS = ("/", "/en/{n}", "/de/{n}.html", "/fr/{n}/", "/article/{n}", "/{w}/{n}", "/index.php", "/a/b/{n}", "/{w}.html", "")
_SYLLABLES = "an ar co da de el fi ga ho il ka lo ma ne or pe ri sa to un ve wi yo zu the ion est ing th sh ch st nt nd ng ly tr pl ck er"
HELD_OUT_SHARE = 4
FALSE_BLOCKS = 0.05
_DIGITS = str.maketrans("123456789", "000000000")
_UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def split_url(url: str | None) -> tuple[str, str]:
    """(host in lower case, path); both empty for null or where ``://`` is missing."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", rest)
    return m[1].translate(_UPPER), m[2]


def matching_rule(host: str, path: str) -> tuple[str, str] | None:
    """(rule, verdict) of the longest rule that fits."""
    fits = [(h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits, key=lambda r: len(r[0])) if fits else None


def labelled_urls(seed: int = 17) -> pd.DataFrame:
    """The labelled table: url, name (of the host), word (that the name is made around), theme, blocked, held_out. Held
    out are whole names, by CRC-32."""
    rng = np.random.default_rng(seed)

    def pick(words):
        return words[int(rng.integers(0, len(words)))]

    shared, plain, traps, parts = _SHARED.split(), _PLAIN.split(), _TRAPS.split(), _SYLLABLES.split()
    bad = {theme: words.split() for theme, words in _THEMES.items()}

    def joined(word: str, own: list[str]) -> str:
        """A host name around one word: alone, with a shared word, an own one, a number or an invented one."""
        other = pick(pick((shared, shared, own, [str(rng.integers(1, 400))], ["".join(pick(parts) for _ in range(2))])))
        mark = pick(("-", "-", ""))
        return pick((word, word + mark + other, other + mark + word, f"{word}{mark}{other}-{pick(shared)}"))

    names: dict[str, tuple[str, str]] = {}  # theme and word
    for theme, words in bad.items():
        for word in words:
            for k in range(16):
                names[joined(word + "s" * (k % 3 == 0 and word[-1] not in "sx"), words)] = theme, word
    for word in plain + _EVERYDAY.split() + 4 * traps:
        for _ in range(6):
            names.setdefault(joined(word, plain), ("plain", word))
    for _ in range(1200):
        name = "".join(pick(parts) for _ in range(int(rng.integers(2, 5))))
        names.setdefault(name, ("plain", name))

    def url(name: str, path: str) -> str:
        return f"http{pick(('', 's'))}://{pick(_PREFIXES)}{name}.{pick(_ENDS)}{path}"

    rows = []
    for name, (theme, word) in names.items():
        held = zlib.crc32(name.encode()) % HELD_OUT_SHARE == 0
        for _ in range(2):
            words = plain if theme == "plain" else bad[theme]
            rows.append((url(name, pick(_PATHS).format(n=rng.integers(1, 9999), w=pick(words if rng.random() < 0.3 else plain))), name, word, theme, int(theme != "plain"), held))
        # a plain host whose path is of an unwanted theme
        if theme == "plain" and rng.random() < 0.15:
            theme = pick(list(bad))
            words = bad[theme]
            rows.append((url(name, pick(("/{0}/{1}", "/{0}-{1}.html", "/x/{0}?{1}", "/{0}")).format(pick(words), pick(words + shared))), name, word, theme, 1, held))
    return pd.DataFrame(rows, columns=["url", "name", "word", "theme", "blocked", "held_out"])


def features(host: str, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed n-grams of the host and of the path, marked by their part, and the weight of each:
    either part counts as one unit vector, so a long path does not drown the host. All digits are read as
    0, since numbers say nothing about a page."""
    parts = []
    for part, text in (("h", f".{host}.".translate(_DIGITS)), ("p", f"{path}/".translate(_DIGITS))):
        out = {zlib.crc32(f"{part}{text[i : i + n]}".encode("utf-8", "surrogatepass")) % BUCKETS for n in SIZES for i in range(len(text) - n + 1)}
        parts.append(np.fromiter(out, np.int64, len(out)))
    return np.concatenate(parts), np.concatenate([np.full(len(p), 1 / math.sqrt(max(len(p), 1))) for p in parts])


def fitted(rows: pd.DataFrame, epochs: int = 120, rate: float = 60.0, decay: float = 1e-5, momentum: float = 0.9) -> tuple[np.ndarray, float]:
    """Weights and bias, by full-batch gradient descent with momentum over ``rows``, each class with half of the weight."""
    flat, scale, owner = _flat_features(rows["url"])
    y = rows["blocked"].to_numpy(float)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, bias = np.zeros(BUCKETS), 0.0
    step, push = np.zeros(BUCKETS), 0.0
    for _ in range(epochs):
        z = bias + np.bincount(owner, w[flat] * scale, len(y))
        g = (1 / (1 + np.exp(-z)) - y) * share
        step = momentum * step - rate * (np.bincount(flat, g[owner] * scale, BUCKETS) + decay * w)
        push = momentum * push - rate * 0.1 * float(g.sum())
        w += step
        bias += push
    return w.astype(np.float32), bias


def _flat_features(column: pd.Series) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n-gram, weight, row) of all n-grams of all urls."""
    feats = [features(*split_url(u)) for u in column]
    return np.concatenate([f for f, _ in feats]), np.concatenate([x for _, x in feats]), np.repeat(np.arange(len(feats)), [len(f) for f, _ in feats])


def calibrated(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
    """``fitted(rows)`` with the bias lowered, if need be, so that of plain rows around words that a model has not
    seen at most ``FALSE_BLOCKS`` are blocked."""
    second = rows["word"].map(lambda word: zlib.crc32(word.encode()) % 2 == 1)
    seen = []
    for half in (second, ~second):
        w, bias = fitted(rows[half])
        flat, scale, owner = _flat_features(rows[~half & (rows["blocked"] == 0)]["url"])
        seen.append(bias + np.bincount(owner, w[flat] * scale))
    w, bias = fitted(rows)
    return w, bias - max(0.0, float(np.quantile(np.concatenate(seen), 1 - FALSE_BLOCKS, method="higher")))


@functools.lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, float]:
    """Weights and bias from the rows that are not held out."""
    rows = labelled_urls()
    return calibrated(rows[~rows["held_out"]])


class Judge:
    """Scores of hosts and paths; a worker remembers those it has met."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.score = functools.lru_cache(maxsize=100_000)(self._score)

    def _score(self, host: str, path: str) -> float:
        f, scale = features(host, path)
        z = self.bias + float(self.weights[f] @ scale)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    def row(self, url: str | None) -> tuple[str, str, str | None, str, float]:
        """(host, path, rule, verdict, score) of one url."""
        host, path = split_url(url)
        rule, p = matching_rule(host, path), self.score(host, path)
        return host, path, rule[0] if rule else None, rule[1] if rule else "block" if p >= 0.5 else "allow", p


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the method's score of every row of ``pages``.

    Null urls and those without ``://`` have empty host and path and are scored as such. Of rules that fit,
    the longest wins; two of one length that fit the same url are the same rule. Null page_ids stay null,
    repeated rows give repeated results, other columns are ignored. The model is of fixed size, so it
    travels with the task.
    """
    model = trained()

    def run(batch, judge):
        rows = [judge.row(url) for url in batch.column("url").to_pylist()]
        yield batch.column("page_id"), *(zip(*rows, strict=True) if rows else [()] * 5)

    return map_batches(pages.select("page_id", "url"), run, "page_id long, host string, path string, rule string, verdict string, score double", lambda: Judge(*model))


def op5_url_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url"))


QUERIES = {"op5_url_ngrams": op5_url_ngrams}
