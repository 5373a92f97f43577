"""Hosts, registrable domains and site keys.

The built-in suffixes are few and part of the expressions.  A public-suffix list of any size is a table (`sources.dims.read_suffixes`): `suffix_index`
keeps it hash-partitioned by suffix, and `with_suffix_sizes` finds the longest match of each host by a join over the host's tails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .core import let, look_up


@dataclass(frozen=True)
class SuffixRules:
    """A public-suffix list as three small sets; `full` switches the generic second-level rule off."""

    rules: frozenset[str]
    wildcards: frozenset[str]
    exceptions: frozenset[str]
    full: bool = False


def builtin_suffixes() -> SuffixRules:
    tokens = K.EXTRA_SUFFIXES
    return SuffixRules(frozenset(t for t in tokens if t[0] not in "*!"),
                       frozenset(t[2:] for t in tokens if t.startswith("*.")),
                       frozenset(t[1:] for t in tokens if t.startswith("!")))


def raw_host(url: Column) -> Column:
    """Lower-case host without user, port and outer dots; internationalised names in their ASCII form."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))
    full = F.when(F.contains(low, F.lit("://")), low).otherwise(F.concat(F.lit("http://"), low))
    host = F.regexp_extract(full, r"^[^:/?#]*://(?:[^/?#@]*@)?(?:\[([^\]]*)\]|([^/?#:]*))", 0)
    bare = F.regexp_replace(F.regexp_replace(host, r"^[^:/?#]*://(?:[^/?#@]*@)?", ""), r"^\[|\]$|^\.+|\.+$", "")
    ascii_host = F.try_reflect(F.lit("java.net.IDN"), F.lit("toASCII"), bare)
    return F.when(bare.rlike(r"[^\x00-\x7F]"), F.coalesce(ascii_host, bare)).otherwise(bare)


def _without_www(host: Column) -> Column:
    return F.when(F.size(F.split(host, r"\.")) >= 3, F.regexp_replace(host, r"^www\d*\.", "")).otherwise(host)


def host_of(url: Column) -> Column:
    return let(raw_host(url), _without_www)


def _in(value: Column, members: frozenset[str]) -> Column:
    return value.isin(*sorted(members)) if members else F.lit(False)


def _suffix_size(host: Column, labels: Column, s: SuffixRules) -> Column:
    """Number of labels in the public suffix.  Candidates run from the whole host to its last label; the first exception,
    rule or wildcard that applies decides."""
    last = F.size(labels)
    positions = F.sequence(F.lit(1), last)

    def tail(start: Column) -> Column:
        return F.array_join(F.slice(labels, start, last - start + 1), ".")

    def size_at(i: Column) -> Column:
        candidate = tail(i)
        parent = F.when(i < last, tail(i + 1)).otherwise(F.lit(""))
        return (F.when(_in(candidate, s.exceptions), last - i)
                .when(_in(candidate, s.rules), last - i + 1)
                .when(_in(parent, s.wildcards), last - i + 1))

    ruled = F.get(F.filter(F.transform(positions, size_at), lambda n: n.isNotNull()), F.lit(0))
    if s.full:
        return F.coalesce(ruled, F.lit(1))
    generic = ((last >= 3) & (F.length(F.element_at(labels, -1)) == 2)
               & F.try_element_at(labels, F.lit(-2)).isin(*K.GENERIC_SECOND_LEVEL))
    return F.when(F.coalesce(ruled, F.lit(1)) > 1, ruled).when(generic, 2).otherwise(F.coalesce(ruled, F.lit(1)))


def domain_of_host(host: Column, suffixes: SuffixRules | Column | None = None) -> Column:
    """Public suffix plus one label; addresses and bare suffixes stay as they are.  `suffixes` may be a column with the number of labels in the
    host's public suffix."""
    rules = builtin_suffixes() if suffixes is None else suffixes

    def joined(labels: Column) -> Column:
        return let(_suffix_size(host, labels, rules) if isinstance(rules, SuffixRules) else F.coalesce(rules, F.lit(1)),
                   lambda n: F.when(F.size(labels) <= n, host)
                   .otherwise(F.array_join(F.slice(labels, F.size(labels) - n, n + 1), ".")))

    is_address = host.rlike(r"^([\d.]+|[0-9a-f:]+)$") & ~host.rlike(r"^[a-f]+$")
    return F.when((host == "") | is_address, host).otherwise(let(F.split(host, r"\."), joined))


def suffix_index(suffixes: DataFrame) -> DataFrame:
    """suffixes(suffix, kind) -> index(tail, exception, rule, wildcard): one row a suffix, partitioned by it."""
    kinds = [F.bool_or(F.col("kind") == kind).alias(kind) for kind in ("exception", "rule", "wildcard")]
    return suffixes.filter("suffix <> ''").groupBy(F.col("suffix").alias("tail")).agg(*kinds)


def with_suffix_sizes(df: DataFrame, url: str, index: DataFrame, out: str = "suffix_size") -> DataFrame:
    """`df` with the number of labels in the public suffix of each address's host.  Each different host is looked up once: it meets the index by its
    tails (at most one row for each label), and the first tail from the left to which an exception, rule or wildcard applies
    decides.  Sizes combine before the shuffle; a host of very many rows is a hot key only of the join back, which AQE splits."""
    named = df.withColumn("__host", host_of(F.col(url)))
    labels = F.split("__host", r"\.")
    tails = (named.select("__host").filter("__host <> ''").distinct().select("__host", labels.alias("labels"))
             .select("__host", "labels", F.size("labels").alias("n"), F.explode(F.sequence(F.lit(1), F.size("labels"))).alias("i"))
             .select("__host", "n", "i", F.array_join(F.slice("labels", F.col("i"), F.col("n") - F.col("i") + 1), ".").alias("tail")))
    # (first label of the suffix's candidate, precedence, labels in the suffix) of each thing that applies; the least decides
    n, i = F.col("n"), F.col("i")
    applies = [F.when(F.col("exception"), F.struct(i.alias("at"), F.lit(0).alias("order"), (n - i).alias("size"))),
               F.when(F.col("rule"), F.struct(i.alias("at"), F.lit(1).alias("order"), (n - i + 1).alias("size"))),
               F.when(F.col("wildcard") & (i > 1), F.struct((i - 1).alias("at"), F.lit(2).alias("order"), (n - i + 2).alias("size")))]
    sizes = tails.join(index, "tail").groupBy("__host").agg(F.min(F.array_min(F.array_compact(F.array(*applies)))).alias("best"))
    return named.join(sizes, "__host", "left").withColumn(out, F.coalesce("best.size", F.lit(1))).drop("__host", "best")


def registrable_domain(url: Column, suffixes: SuffixRules | Column | None = None) -> Column:
    return let(host_of(url), lambda host: domain_of_host(host, suffixes))


def owner_key(url: Column, host: Column) -> Column:
    """Owner key of a shared host: host plus owner path parts, or the owner's subdomain; NULL elsewhere."""
    depth = look_up(K.OWNER_IN_PATH, host).cast("int")
    path = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), r"^[^/?#]*://", ""), r"^[^/?#]*|[?#].*$", "")
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    parent = F.when(F.size(F.split(host, r"\.")) >= 3, F.regexp_extract(host, r"^[^.]*\.(.*)$", 1))
    return (F.when(depth.isNotNull(), F.when(F.size(parts) >= depth,
                   F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), depth), "/"))))
            .when(parent.isin(*K.OWNER_IN_SUBDOMAIN), host))


def site_key(url: Column, suffixes: SuffixRules | Column | None = None) -> Column:
    """One key per site: owner of a shared host, else the registrable domain; addresses and single labels keep the port."""
    port = F.regexp_extract(F.regexp_replace(F.trim(url), r"^[^/?#]*://", ""), r"^(?:[^/?#@]*@)?(?:\[[^\]]*\]|[^/?#:]*):(\d+)", 1)

    def key(host: Column) -> Column:
        domain = domain_of_host(host, suffixes)
        keeps_port = (host.rlike(r"^([\d.]+|[0-9a-f:]+)$") | ~F.contains(host, F.lit("."))) & (host != "") & (port != "")
        return F.coalesce(owner_key(url, host), F.when(keeps_port, F.concat(domain, F.lit(":"), port)).otherwise(domain))

    return let(host_of(url), key)


def slug(key: Column) -> Column:
    """A site key as an identifier; `source` for a key without Latin letters or digits (ids are told apart by numbers afterwards)."""
    text = F.regexp_replace(F.regexp_replace(F.lower(key), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(text, F.lit("")), F.lit("source"))


def path_of(url: Column) -> Column:
    """Path of a link without a trailing slash; '/' for none."""
    path = F.regexp_replace(F.regexp_replace(F.trim(url), r"^[^/?#]*://[^/?#]*", ""), r"[?#].*$", "")
    return F.coalesce(F.nullif(F.regexp_replace(path, "/+$", ""), F.lit("")), F.lit("/"))
