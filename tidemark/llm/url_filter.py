"""URL filter: longest-fitting host and path rules, and for the rest a logistic regression on hashed character n-grams.

Features are the n-grams (3 to 5 characters, with edge marks) of the host and of the path, each with its own prefix,
hashed by crc32 into ``2 ** BITS`` buckets; a document's vector has unit length. The model is fitted here, once a session,
on the small labelled table ``TRAINING`` by full-batch gradient descent, and its weights have a fixed size. It is asked only
where no rule fits; ``probability`` is null elsewhere.

Defined cases: a url that is null or has no ``://`` has empty host and path and fits no rule; without any n-gram there is
nothing against a url, so its probability is 0 and the verdict allow; a bare host has an empty path; repeated rows give a row each; only page_id and url are read.
"""

from __future__ import annotations

import zlib
from functools import cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_value

by_value(__name__)

BITS, SIZES = 15, (3, 4, 5)
#: (host, path, verdict)
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

BLOCKED = """
http://spam-farm.example.org/en/1 https://www.spam-links.example.com/offer/22 http://blog.spam-farm.example.net/fr/88.html https://spamhub.example.com/a
http://cheap-pills.example.com/en/450 https://www.cheap-meds.example.net/buy/1 http://m.cheap-pills.example.org/es/12?page=2 https://pills-online.example.com/order
http://casino-win.example.net/en/35 https://www.casino-royal.example.com/play http://blog.casino-slots.example.org/de/9 https://online-casino.example.net/bonus/7
https://adult-x.example.com/en/27 http://www.adult-videos.example.net/12 https://xxx-movies.example.org/fr/3 http://m.adult-chat.example.com/es/44/
http://free-bets.example.net/en/39 https://www.free-spins.example.com/de/17 http://free-bets-today.example.org/fr/5 https://bets-bonus.example.net/es/3
https://m.ads-track.example.com/en/5 http://ads-server.example.net/click/9 https://www.ads-popunder.example.org/de/2 http://ads-track.example.com/fr/812
http://replica-watches.example.com/sale https://payday-loans.example.net/apply/now http://viagra-shop.example.org/en/2 https://www.crypto-doubler.example.com/win
http://clickbait-news.example.net/shock/1 https://malware-host.example.org/setup.exe http://phishing-login.example.com/bank/verify https://warez-crack.example.net/keygen
http://poker-jackpot.example.com/de/3 https://slots-jackpot.example.org/es/8 http://escort-dates.example.net/fr/1 https://hot-singles.example.com/en/6
http://lottery-winner.example.org/claim https://miracle-diet.example.net/en/4 http://get-rich-quick.example.com/de/5 https://torrent-pirate.example.org/fr/7
https://link-spam.example.net/de/4 http://m.spam-site.example.org/en/31 https://pills-cheap.example.org/fr/6 http://www.diet-pills.example.com/es/2 http://casino-jackpot.example.com/en/8
https://m.casino-bonus.example.net/fr/41 http://www.adult-dating.example.org/en/6 https://adult-cams.example.net/de/77 https://free-casino.example.com/fr/2 http://www.free-slots.example.net/en/70
http://sports-bets.example.com/en/18 https://blog.ads-network.example.net/es/5 http://popunder-ads.example.org/fr/11 https://track-ads.example.com/de/63 http://replica-bags.example.net/fr/9
https://www.cheap-replica.example.org/en/12 http://quick-loans.example.com/de/1 https://payday-cash.example.org/es/7 http://cheap-viagra.example.net/fr/3 https://crypto-win.example.org/en/90
http://free-crypto.example.com/de/15 https://shock-clickbait.example.com/fr/4 http://malware-free.example.net/en/13 https://phishing-bank.example.com/es/20 http://warez-free.example.org/de/33
https://crack-warez.example.com/fr/8 http://poker-win.example.net/es/14 https://online-poker.example.org/en/51 http://hot-escort.example.com/de/29 https://escort-girls.example.net/en/3
http://singles-dating.example.org/fr/10 https://lottery-win.example.com/en/66 http://free-lottery.example.net/de/38 https://miracle-pills.example.com/es/19 http://rich-quick-win.example.org/fr/23
""".split()
ALLOWED = """
http://ththre.example.com/fr/825?page=2 https://m.therth.example.net/en/25 https://thther.example.org/en/685 http://therha.example.com/de/676 https://therin.example.net/en/770
https://blog.tiontion.example.com/es/853/ http://blog.ththan.example.net/en/960 https://m.therou.example.com/en/474.html https://ththin.example.org/en/671 http://blog.tionth.example.net/fr/369
https://www.ererer.example.org/de/148.html http://tionsh.example.net/en/14232 https://tionble.example.com/es/333 http://ingion.example.org/fr/77.html https://www.handre.example.net/en/9
https://news.example.com/world/article/12 http://www.library.example.org/catalog/88 https://university.example.net/research/papers/5 http://blog.gardening.example.com/roses/
https://docs.example.org/manual/chapter/3 http://wiki.example.net/history/of/bread https://museum.example.com/en/exhibits/14 http://weather.example.org/de/berlin https://recipes.example.net/fr/tarte
https://school.example.com/lessons/algebra http://journal.example.org/volume/7/issue/2 https://hiking.example.net/trails/es/21 http://music.example.com/scores/bach https://health.example.org/en/nutrition
http://city.example.net/council/minutes https://theatre.example.com/program/fr/9 http://chess.example.org/openings/de/4 https://books.example.net/review/en/311 http://photos.example.com/birds/17
https://www.andthe.example.com/en/7015 http://ondhat.example.net/de/811 https://enbler.example.org/es/90 http://m.oustha.example.com/fr/64/ https://blog.leaing.example.org/en/2048
http://a.com http://b.org/ https://x.net https://news.com http://uni.edu/ https://my.blog.com/ http://www.example.com http://example.org/ https://example.net http://c.de/ https://d.fr http://town.es
""".split()
TRAINING = [(u, 1) for u in BLOCKED] + [(u, 0) for u in ALLOWED]


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host from after the first ``://`` up to ``/ ? #``, A-Z lower-cased; the path from there to ``? #``."""
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    path = rest[end:]
    stop = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), path[:stop]


def features(host: str, path: str) -> np.ndarray:
    """Distinct buckets."""
    found = set()
    for mark, text in (("h", host), ("p", path)):
        if text:
            text = f"^{text}$"
            for n in SIZES:
                found.update(zlib.crc32(f"{mark}{text[i : i + n]}".encode("utf-8", "replace")) & ((1 << BITS) - 1) for i in range(len(text) - n + 1))
    return np.fromiter(found, np.int64, len(found))


def fit(table: list[tuple[str, int]], rounds: int = 400, rate: float = 4.0, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """(weights, bias) of the labelled urls (1: block)."""
    x = np.zeros((len(table), 1 << BITS), np.float32)
    for i, (url, _) in enumerate(table):
        f = features(*split_url(url))
        x[i, f] = 1 / np.sqrt(max(1, len(f)))
    used = np.flatnonzero(x.any(axis=0))
    x, y = x[:, used].astype(float), np.array([label for _, label in table], float)
    w, b = np.zeros(len(used)), 0.0
    for _ in range(rounds):
        error = 1 / (1 + np.exp(-(x @ w + b))) - y
        w -= rate * (x.T @ error / len(y) + penalty * w)
        b -= rate * error.mean()
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return weights, b


@cache
def model() -> tuple[np.ndarray, float]:
    return fit(TRAINING)


def probability(host: str, path: str, weights: np.ndarray, bias: float) -> float:
    f = features(host, path)
    if not len(f):
        return 0.0
    return float(1 / (1 + np.exp(-(weights[f].sum() / np.sqrt(len(f)) + bias))))


def host_path(url: Column | str = "url") -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)"))
    host = F.translate(F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.coalesce(F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, threshold: float = 0.5) -> DataFrame:
    """(page_id, host, path, rule, verdict, probability); ``rule`` is the host and path of the longest rule that fits."""
    host, path = host_path("url")
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    longest = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r))
    fits = [((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p) for h, p, _ in longest]
    pick = lambda value: reduce(lambda c, i: c.when(fits[i], F.lit(value(longest[i]))), range(len(fits)), F)
    weights, bias = model()

    @F.pandas_udf("double")
    def chance(hosts: pd.Series, paths: pd.Series, ruled: pd.Series) -> pd.Series:
        return pd.Series([None if r is not None else probability(h, p, weights, bias) for h, p, r in zip(hosts, paths, ruled)], dtype="Float64")

    rows = rows.select("*", pick(lambda r: r[0] + r[1]).alias("rule"), pick(lambda r: r[2]).alias("ruled"))
    rows = rows.withColumn("probability", chance("host", "path", "ruled"))
    verdict = F.coalesce("ruled", F.when(F.col("probability") > threshold, "block").otherwise("allow"))
    return rows.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "probability")
