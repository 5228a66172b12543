"""URL filters over a sorted digest array.

A list's entries (host suffix and path prefix, as one string) are sorted by their 64-bit xxhash in one file: digests,
offsets, the lengths that path prefixes have, verdicts, strings.  Spark hands the file to every executor, also to one that joins later; tasks map it into
memory, probe it with a vectorised binary search for all candidates of a batch, and compare the stored string of each
hit, so that equal digests of different strings can't decide.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

from .common import map_batches, scratch

#: (verdict, host and path): a rule fits its host and all subdomains if the path starts with the rule's (fixed values).
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
#: Hosts of adverts, trackers, gambling, adult content and miners: blocked where no rule fits (fixed values).
BLOCKED = [
    "doubleclick.net/",
    "googlesyndication.com/",
    "googleadservices.com/",
    "2mdn.net/",
    "adnxs.com/",
    "adsrvr.org/",
    "criteo.com/",
    "criteo.net/",
    "taboola.com/",
    "outbrain.com/",
    "revcontent.com/",
    "mgid.com/",
    "scorecardresearch.com/",
    "quantserve.com/",
    "rubiconproject.com/",
    "pubmatic.com/",
    "openx.net/",
    "casalemedia.com/",
    "moatads.com/",
    "amazon-adsystem.com/",
    "smartadserver.com/",
    "bidswitch.net/",
    "serving-sys.com/",
    "mathtag.com/",
    "media.net/",
    "adroll.com/",
    "bluekai.com/",
    "krxd.net/",
    "demdex.net/",
    "adform.net/",
    "yieldmo.com/",
    "sharethrough.com/",
    "teads.tv/",
    "zedo.com/",
    "popads.net/",
    "popcash.net/",
    "propellerads.com/",
    "onclickads.net/",
    "exoclick.com/",
    "exosrv.com/",
    "juicyads.com/",
    "trafficjunky.net/",
    "trafficfactory.biz/",
    "adsterra.com/",
    "clickadu.com/",
    "hilltopads.net/",
    "coinhive.com/",
    "coin-hive.com/",
    "crypto-loot.com/",
    "1xbet.com/",
    "bet365.com/",
    "pokerstars.com/",
    "888casino.com/",
    "stake.com/",
    "pornhub.com/",
    "xvideos.com/",
    "xnxx.com/",
    "xhamster.com/",
    "redtube.com/",
    "youporn.com/",
]
SEED = 0


def packed(entries: list[tuple[str, str]]) -> bytes:
    """The file of a list: numbers of entries and of lengths, sorted digests, offsets of the strings, distinct lengths of path prefixes, verdicts (1: block), strings."""
    rows = sorted((xxhash.xxh64_intdigest(key.encode(), SEED), key.encode(), verdict == "block") for verdict, key in set(entries))
    offsets = np.cumsum([0] + [len(key) for _, key, _ in rows])
    lengths = sorted({len(key) - key.index(b"/") for _, key, _ in rows if b"/" in key})
    return b"".join([np.array([len(rows), len(lengths)], "<u8").tobytes(), np.array([r[0] for r in rows], "<u8").tobytes(), offsets.astype("<u8").tobytes(), np.array(lengths, "<u8").tobytes(), bytes(r[2] for r in rows), *(r[1] for r in rows)])


class DigestArray:
    """A packed list, mapped into memory."""

    def __init__(self, path: str):
        n, m = np.fromfile(path, "<u8", 2).tolist()
        self.digests = np.memmap(path, "<u8", "r", 16, (n,)) if n else np.empty(0, "<u8")
        self.offsets = np.memmap(path, "<u8", "r", 16 + 8 * n, (n + 1,))
        self.lengths = np.fromfile(path, "<u8", m, offset=24 + 16 * n).tolist()
        rest = np.memmap(path, np.uint8, "r", 24 + 16 * n + 8 * m, None) if n else np.empty(0, np.uint8)
        self.verdicts, self.strings = rest[:n], rest[n:]

    def _string(self, k: int) -> bytes:
        return self.strings[int(self.offsets[k]) : int(self.offsets[k + 1])].tobytes()

    def find(self, candidates: list[bytes]) -> list[int]:
        """For each candidate its place in the list, or -1."""
        wanted = np.array([xxhash.xxh64_intdigest(c, SEED) for c in candidates], "<u8")
        first = np.searchsorted(self.digests, wanted)
        out = [-1] * len(candidates)
        for i in np.flatnonzero(first < len(self.digests)):
            k = int(first[i])
            while k < len(self.digests) and self.digests[k] == wanted[i]:
                if self._string(k) == candidates[i]:
                    out[i] = k
                    break
                k += 1
        return out

    def candidates(self, host: str, path: str) -> list[bytes]:
        """What entries that fit this host and path look like."""
        labels, raw = host.encode().split(b"."), path.encode()
        return [b".".join(labels[k:]) + raw[:n] for k in range(len(labels)) for n in self.lengths if n <= len(raw)] if host else []


def split(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path of a url; both empty if it is null or has no ``://``."""
    _, found, rest = (url or "").partition("://")
    if not found:
        return "", ""
    ends = [i for i in map(rest.find, "/?#") if i >= 0]
    host = rest[: min(ends, default=len(rest))]
    path = rest[len(host) :].partition("?")[0].partition("#")[0]
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def distribute(spark: SparkSession, entries: list[tuple[str, str]]) -> str:
    """Put a packed list into the shared folder and have Spark hand it to the executors; gives its name there."""
    data = packed(entries)
    name = f"jobloom-urls-{xxhash.xxh64_hexdigest(data)}-{len(data)}"
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{scratch(spark)}/{name}")
    files = path.getFileSystem(sc._jsc.hadoopConfiguration())
    if not files.exists(path):
        out = files.create(path, True)
        out.write(bytearray(data))
        out.close()
    sc.addFile(path.toString())
    return name


def judged(pages: DataFrame, rules: list[tuple[str, str]] = RULES, blocked: list[str] = BLOCKED) -> DataFrame:
    """(page_id, host, path, rule, verdict): the longest rule that fits decides, else whether the host is in the block list.

    A url that is null or has no ``://`` has an empty host and path, fits nothing and is allowed.  Whole urls of any
    length are judged; repeated rows give a row each; an empty table gives no rows; other columns are ignored.
    """
    own, other = distribute(pages.sparkSession, rules), distribute(pages.sparkSession, [("block", b) for b in blocked])

    def make():
        lists = [DigestArray(SparkFiles.get(name)) for name in (own, other)]

        def best(array: DigestArray, parts: list[tuple[str, str]]) -> list[int]:
            """The place of the longest entry that fits each host and path, or -1."""
            each = [array.candidates(h, p or "/") if array is lists[1] else array.candidates(h, p) for h, p in parts]
            found = iter(array.find([c for own_ in each for c in own_]))
            return [max(((len(c), k) for c in own_ if (k := next(found)) >= 0), default=(0, -1))[1] for own_ in each]

        def run(ids, urls):
            parts = [split(u) for u in urls]
            by_rule, by_list = best(lists[0], parts), best(lists[1], parts)
            rule = [lists[0]._string(k).decode() if k >= 0 else None for k in by_rule]
            block = [bool(lists[0].verdicts[k]) if k >= 0 else m >= 0 for k, m in zip(by_rule, by_list)]
            return [ids, [h for h, _ in parts], [p for _, p in parts], rule, ["block" if b else "allow" for b in block]]

        return run

    return map_batches(pages, ["page_id", "url"], make, "page_id bigint, host string, path string, rule string, verdict string")


_VALUES = ", ".join(f"('{v}', '{k.partition('/')[0]}', '/{k.partition('/')[2]}', '{k}')" for v, k in RULES)
_HOSTS = ", ".join(f"('{b.rstrip('/')}')" for b in BLOCKED)
ORACLE = rf"""
WITH s AS (SELECT page_id, strpos(coalesce(url, ''), '://') AS i, coalesce(url, '') AS u FROM pages),
r AS (SELECT page_id, CASE WHEN i > 0 THEN substr(u, i + 3) ELSE '' END AS rest FROM s),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM r),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
rules(verdict, host, path, rule) AS (VALUES {_VALUES}),
blocked(host) AS (VALUES {_HOSTS}),
l AS (SELECT DISTINCT p.host FROM p JOIN blocked b ON p.host = b.host OR ends_with(p.host, '.' || b.host)),
f AS (SELECT p.page_id, max_by(struct_pack(rule := rules.rule, verdict := rules.verdict), length(rules.rule)) AS best FROM p JOIN rules ON (p.host = rules.host OR ends_with(p.host, '.' || rules.host)) AND starts_with(p.path, rules.path) GROUP BY p.page_id)
SELECT p.page_id, p.host, p.path, best.rule AS rule, coalesce(best.verdict, CASE WHEN p.host IN (SELECT host FROM l) THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN f USING (page_id)
"""
