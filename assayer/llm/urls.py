"""URL filters: path rules, and logistic regression on hashed character n-grams of host and path, scored by SQL functions.

The model is fitted on the driver on a small labelled table of URLs. The longest rule that fits decides; the model decides
the rest.

A null URL, or one without `://`, has an empty host and path, fits no rule and gets the model's verdict on nothing: allow.
Long URLs count whole. Repeated rows are judged alike, rows without page_id too; an empty table gives no rows. Of rules equally
long the first listed counts, and a score of just 0.5 blocks. Other columns, whatever their names, are left out.
"""

from __future__ import annotations

import json
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values: (verdict, host, path).
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))

SIZES, BUCKETS = (3, 4, 5), 1 << 13
STEPS, RATE, DECAY = 600, 2.0, 1e-5
#: The n-grams of host and of path weigh so much together.
SCALE = {"h": 20.0, "p": 5.0}
#: Share of URLs to block that a corpus is expected to hold; the labelled table has as many of either kind.
PRIOR = 0.35

#: The labelled table, of made-up names of common kinds: URLs to block, then to allow.
BLOCK = """
http://royal-casino.example/play https://casino-bonus.test/signup https://www.online-casino.example/slots/free
http://poker-room.example/bonus https://slots-jackpot.test/spin http://bingo-jackpot.example/win https://roulette-win.test/now
http://sports-bets.example/odds https://betting-tips.test/win https://bet-bonus.example/free-bet http://www.best-bets.test/today
https://viagra-pharmacy.example/order http://discount-pills.test/buy/cialis https://diet-pills.example/slim http://meds-no-prescription.test/cheap
https://m.pills-shop.example/cart http://cheap-meds.test/order https://weight-loss-miracle.example/buy http://pharma-discount.test/xanax
https://porn-tube.example/watch http://xxx-videos.test/free https://adult-cams.example/live http://sex-dating.test/meet
https://hot-xxx.example/gallery http://www.adult-dating.test/chat https://adult-films.example/xxx http://free-porn.test/hd
https://nude-cams.example/girls http://escort-adult.test/city https://blog.sexy-adult.example/pics http://hardcore-porn.test/clips
https://spam-links.example/seo/backlinks http://link-spam.test/page/9 https://seo-link-farm.example/backlinks http://spam-blog.test/auto
https://article-farm.example/spin http://content-farm.test/links https://buy-backlinks.example/farm http://spam-comments.test/farm
https://ads-server.example/click http://ad-clicks.test/banner https://click-tracker.example/pixel http://tracking-ads.test/track
https://popup-ads.example/redirect http://track-clicks.test/r https://www.adserver.example/ads/banner http://track.ads-network.test/pixel
https://replica-watches.example/sale http://fake-bags.test/cheap https://payday-loans.example/apply http://quick-cash-loans.test/now
https://lottery-winner.example/claim http://free-prize.test/claim https://win-free-phone.example/survey http://win-cash.test/now
https://crack-keygen.example/download http://warez-torrents.test/free https://malware-download.example/setup.exe http://phish-login.test/verify-account
https://get-rich-quick.example/crypto http://free-coins.test/crypto/bonus https://cheap-replica.example/buy http://cheap-followers.test/buy
""".split()
ALLOW = """
http://city-library.example/catalogue https://www.daily-news.test/politics/article http://gardening.example/roses https://weather.test/forecast/today
http://cooking-recipes.example/soup https://school-district.test/calendar http://history-museum.example/exhibits https://physics-notes.test/lecture
http://open-data.example/tables/1 https://hiking-trails.test/maps/north http://bird-watching.example/page/9 https://travel-diary.test/lisbon
http://music-theory.example/scales https://book-reviews.test/fiction http://film-archive.example/silent https://chess-club.test/games
http://health-service.example/advice https://town-council.test/minutes http://watch-repair.example/guide https://leather-craft.test/tools
http://credit-union.example/savings https://tax-office.test/forms http://science-journal.example/issue/4 https://art-school.test/students
http://software-docs.example/download https://river-survey.test/data http://astronomy.example/planets https://mail.test/account
http://phone-manuals.example/models https://nutrition.test/vitamins http://theatre.example/tickets https://engineering.test/bridges
http://railway-times.example/line https://family-tree.test/records http://language-courses.example/lessons https://first-aid.test/steps
http://economics.example/papers https://coin-collectors.test/catalogue http://university.example/courses https://geology.test/rocks
http://www.farmers-market.example/apples https://dairy-farm.test/cheese http://forum.linux-users.example/thread/77 https://wiki.mathematics.test/theorem
http://blog.knitting.example/patterns https://m.bus-routes.test/stops http://poetry.example/sonnets https://chemistry.test/elements
http://parliament.example/debates https://orchestra.test/season http://volcano-watch.example/reports https://sailing.test/harbours
http://beekeeping.example/hives https://translation.test/glossary http://climate-atlas.example/rain https://cathedral.test/tours
http://hospital.example/wards https://kindergarten.test/games http://philosophy.example/essays https://photography.test/lenses
http://statistics.example/census https://fishing.test/rivers http://pottery.example/glazes https://cycling.test/routes
http://encyclopedia.example/a/physics https://dictionary.test/word/tree http://archive.example/1999/05 https://observatory.test/images
http://bakery.example/bread https://library-consortium.test/loans http://insects.example/beetles https://textbooks.test/grade/7
""".split()


def parts(url: str | None) -> tuple[str, str]:
    """Host and path of a URL."""
    before, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
    host, tail = rest[:end], rest[end:]
    path = tail[: min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path


def _buckets(mark: str, part: str) -> list[int]:
    return [zlib.crc32((mark + part[i : i + n]).encode()) % BUCKETS for n in SIZES for i in range(len(part) - n + 1)]


def features(urls: list[str]) -> np.ndarray:
    """A row of BUCKETS for each URL; a part's n-grams count as shares of the part."""
    x = np.zeros((len(urls), BUCKETS))
    for row, url in zip(x, urls):
        for mark, part in zip("hp", parts(url)):
            grams = _buckets(mark, part)
            np.add.at(row, grams, SCALE[mark] / max(len(grams), 1))
    return x


def fit(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression by gradient descent, moved from the table's balance to PRIOR."""
    w, bias, n = np.zeros(x.shape[1]), 0.0, len(y)
    used = np.flatnonzero(x.any(axis=0))
    x, v = x[:, used], np.zeros(len(used))
    for _ in range(STEPS):
        d = 1 / (1 + np.exp(-np.clip(x @ v + bias, -40, 40))) - y
        bias -= RATE / 10 * d.mean()
        v -= RATE * (d @ x / n + DECAY * v)
    w[used] = v
    share = y.mean()
    return w, float(bias + np.log(PRIOR / (1 - PRIOR)) - np.log(share / (1 - share)))


@lru_cache(1)
def learn() -> tuple[np.ndarray, float]:
    """(weights, bias) from the labelled table."""
    return fit(features(BLOCK + ALLOW), np.array([1.0] * len(BLOCK) + [0.0] * len(ALLOW)))


def host() -> Column:
    """SQL of the host of column url."""
    return F.translate(F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path() -> Column:
    return F.regexp_extract(F.coalesce("url", F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _part_score(mark: str, part: str) -> str:
    """SQL of a part's share of the score; w holds the weights."""
    grams = " , ".join(
        f"if(length({part}) < {n}, cast(array() as array<string>), transform(sequence(1, greatest(length({part}) - {n - 1}, 1)), i -> concat('{mark}', substring({part}, i, {n}))))" for n in SIZES
    )
    return f"aggregate(flatten(array({grams})), struct(0.0D as s, 0 as n), (a, g) -> struct(a.s + w[cast(crc32(cast(g as binary)) % {BUCKETS} as int)] as s, a.n + 1 as n), a -> if(a.n = 0, 0.0D, {SCALE[mark]} * a.s / a.n))"


def judged(pages: DataFrame) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score (of block) of each row of pages (page_id, url)."""
    weights, bias = learn()
    rows = pages.select("page_id", host().alias("host"), path().alias("path"))
    rule = None
    for _, h, p in sorted(RULES, key=lambda r: (-len(r[1] + r[2]), RULES.index(r))):
        fits = ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
    # One literal, which the optimizer folds to an array.
    literal = F.from_json(F.lit(json.dumps(weights.tolist())), "array<double>")
    scored = rows.withColumn("w", literal).select("page_id", "host", "path", rule.alias("rule"), F.expr(f"{bias!r}D + {_part_score('h', 'host')} + {_part_score('p', 'path')}").alias("z"))
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("z")))))
    by_rule = F.create_map(*(F.lit(x) for v, h, p in RULES for x in (h + p, v)))
    verdict = F.coalesce(by_rule[F.col("rule")], F.when(score >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), score.alias("score"))
