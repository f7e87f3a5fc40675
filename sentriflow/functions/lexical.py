"""Functions on names, addresses and log fields."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .stats import entropy, let

# Protocol numbers, DNS types and codes, TLS versions and flag bits of the formats.
PROTOCOLS = {6: "TCP", 17: "UDP", 1: "ICMP", 58: "ICMPv6"}
PROTOCOL_NUMBERS = {"tcp": 6, "udp": 17, "icmp": 1, "icmp6": 58}
DNS_TYPES = {1: "A", 2: "NS", 5: "CNAME", 6: "SOA", 12: "PTR", 15: "MX", 16: "TXT", 28: "AAAA", 33: "SRV", 255: "ANY"}
DNS_CODES = {0: "NOERROR", 1: "FORMERR", 2: "SERVFAIL", 3: "NXDOMAIN", 5: "REFUSED"}
TLS_13 = ("tls 1.3", "tlsv1.3", "tlsv13", "tls1.3")
TLS_12 = ("tls 1.2", "tlsv1.2", "tlsv12", "tls1.2")
TLS_OLD = ("tls 1.0", "tls 1.1", "ssl 3.0", "ssl3.0", "tlsv1", "tlsv1.0", "tlsv1.1", "sslv3")
FIN, SYN, RST, PSH, ACK, URG, ECE, CWR = 1, 2, 4, 8, 16, 32, 64, 128
EMPTY_FIELDS = ("-", "(empty)", "")


def dictionary(code: Column, names: dict) -> Column:
    """The name of a code, or the code as text."""
    table = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    return F.coalesce(F.element_at(table, code), code.cast("string"))


def characters(s: Column) -> Column:
    return F.when(F.length(s) > 0, F.split(s, "")).otherwise(F.array().cast("array<string>"))


def string_entropy(s: Column) -> Column:
    """Entropy of the characters in lower case; 0 for an empty or null text. A character's number is what its removal shortens the text by, which is one call instead of one per character."""

    def bits(low: Column) -> Column:
        n = F.length(low)
        shares = F.transform(F.array_distinct(characters(low)), lambda x: (n - F.length(F.replace(low, x, F.lit("")))) / n)
        return F.greatest(F.lit(0.0), F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p)))

    return let(F.lower(F.coalesce(s, F.lit(""))), bits)


def ngrams(s: Column, n: int = 3) -> Column:
    """The n-grams of a text in lower case; none if it is shorter."""

    def grams(low: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(low) - (n - 1)), lambda i: F.substr(low, i, F.lit(n)))
        return F.when(F.length(low) >= n, found).otherwise(F.array().cast("array<string>"))

    return let(F.lower(F.coalesce(s, F.lit(""))), grams)


def ngram_entropy(s: Column, n: int = 3) -> Column:
    """Entropy of the n-grams."""
    return entropy(ngrams(s, n))


def ngram_count_entropy(s: Column, n: int = 3) -> Column:
    """Entropy of how often n-grams occur: 0 if all occur equally often. The detectors' thresholds are for this one."""
    counts = lambda g: F.transform(F.array_distinct(g), lambda v: F.size(F.filter(g, lambda x: x == v)))
    # where none occurs twice, as in most names, there is nothing to count
    return let(ngrams(s, n), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0.0).otherwise(entropy(counts(g))))


def bare_name(qname: Column) -> Column:
    return F.rtrim(qname, F.lit("."))


def labels(qname: Column) -> Column:
    return F.filter(F.split(bare_name(qname), r"\."), lambda x: x != "")


def share_of(s: Column, pattern: str) -> Column:
    """Share of the characters of `s` that match."""
    return F.length(F.regexp_replace(s, f"[^{pattern}]", "")) / F.greatest(F.length(s), F.lit(1))


def subnet(ip: Column) -> Column:
    """IPv4 as its /24, IPv6 as its /64 in canonical short form, anything else unchanged."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    v4 = F.concat(F.substring_index(ip, ".", 3), F.lit(".0/24"))
    # an IPv4 address at the end stands for two groups, which aren't in the net
    plain = F.regexp_replace(ip, rf"(?<=:){octet}(?:\.{octet}){{3}}$", "0:0")
    return F.when(ip.rlike(rf"^{octet}(?:\.{octet}){{3}}$"), v4).when(plain.rlike(r"^[0-9A-Fa-f:]+$") & ip.contains(":"), _v6_net(ip, plain)).otherwise(ip)


def _v6_net(ip: Column, plain: Column) -> Column:
    short_form = plain.contains("::")
    head, tail = F.substring_index(plain, "::", 1), F.when(short_form, F.substring_index(plain, "::", -1)).otherwise("")
    none = F.array().cast("array<string>")
    parts = lambda s: F.when(s == "", none).otherwise(F.split(s, ":"))
    whole = F.size(parts(head)) + F.size(parts(tail))
    zeros = F.array_repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(8) - whole))
    groups = F.concat(parts(head), F.when(short_form, zeros).otherwise(none), parts(tail))
    short = F.transform(F.slice(groups, 1, 4), lambda g: F.regexp_replace(F.lower(g), "^0+(?=.)", ""))
    good = F.forall(groups, lambda g: g.rlike("^[0-9A-Fa-f]{1,4}$")) & ~plain.rlike("::.*::|:::") & F.when(short_form, whole <= 7).otherwise(whole == 8)
    # the run of zeros at the end is the longest one, so the net's own zeros before it join it
    return F.when(good, F.concat(F.regexp_replace(F.array_join(short, ":"), "(?:^|:)0(?::0)*$", ""), F.lit("::/64"))).otherwise(ip)


def stripped(s: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def null_field(s: Column) -> Column:
    """A field of a log without white space around it; null for the marks of an empty field."""
    return F.when(stripped(s).isin(*EMPTY_FIELDS), None).otherwise(stripped(s))


def int_field(s: Column) -> Column:
    return null_field(s).try_cast("double").cast("long")


def double_field(s: Column) -> Column:
    return null_field(s).try_cast("double")


def bool_field(s: Column) -> Column:
    return F.when(s == "T", True).when(s == "F", False)


def history_flags(history: Column) -> Column:
    """TCP flags that a connection history tells: S, A, F and R in either case."""
    up = F.upper(history)
    bit = lambda letter, value: F.when(up.contains(letter), value).otherwise(0)
    return F.when(history.isNotNull(), bit("S", SYN) + bit("A", ACK) + bit("F", FIN) + bit("R", RST))


def has_flag(flags: Column, bit: int) -> Column:
    return F.coalesce(flags.bitwiseAND(bit) != 0, F.lit(False))


def is_syn(flags: Column) -> Column:
    return has_flag(flags, SYN) & ~has_flag(flags, ACK)


def is_syn_ack(flags: Column) -> Column:
    return has_flag(flags, SYN) & has_flag(flags, ACK)


def tls_class(version: Column) -> Column:
    """tls13, tls12 or old; null for others."""
    v = F.lower(F.trim(version))
    return F.when(v.isin(*TLS_13), "tls13").when(v.isin(*TLS_12), "tls12").when(v.isin(*TLS_OLD), "old")


def label_class(label: Column, rules: list[tuple[tuple[str, ...], str]], other: str = "UNKNOWN") -> Column:
    """The class of the first rule of which the label, trimmed and in capitals, holds a word."""
    up, out = F.upper(F.trim(F.coalesce(label, F.lit("")))), None
    for needles, name in rules:
        hit = F.lit(False)
        for x in needles:
            hit = hit | up.contains(x)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.lit(other) if out is None else out.otherwise(other)
