"""Which urls may be fetched: scheme, port and literal addresses, in Spark SQL expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Networks that are not to be reached, and the ports that are.
BLOCKED_V4 = (
    "0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.168.0.0/16", "100.64.0.0/10",
    "192.0.0.0/24", "198.18.0.0/15", "224.0.0.0/4", "240.0.0.0/4",
)
BLOCKED_V6 = ("::1/128", "fc00::/7", "fe80::/10", "64:ff9b::/96")
PORTS = (80, 443, 8080, 8443)


def once(value: Column, body) -> Column:
    """body(value), with value worked out and written down once however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def v4_number(ip: Column) -> Column:
    """A dotted address as a number; null for anything else."""
    byte = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    parts = F.split(ip, r"\.")
    number = reduce(lambda n, i: n * 256 + F.get(parts, F.lit(i)).try_cast("long"), range(4), F.lit(0).cast("long"))
    return F.when(ip.rlike(rf"^{byte}(\.{byte}){{3}}$"), number)


def v6_digits(ip: Column) -> Column:
    """The 32 hexadecimal digits of an IPv6 address, a dotted tail included; null for anything else."""
    tail = v4_number(F.regexp_extract(ip, r"([0-9.]+)$", 1))
    dotted = F.lpad(F.lower(F.hex(tail)), 8, "0")
    joined = F.concat(F.regexp_extract(ip, r"^(.*:)[0-9.]+$", 1), F.substring(dotted, 1, 4), F.lit(":"), F.substring(dotted, 5, 4))
    plain = F.lower(F.when(F.contains(ip, F.lit(".")), joined).otherwise(ip))
    padded = lambda x: F.array_join(F.transform(F.filter(F.split(x, ":"), lambda g: g != ""), lambda g: F.lpad(g, 4, "0")), "")

    def whole(text: Column) -> Column:
        sides = F.split(text, "::")
        both = F.struct(padded(F.get(sides, F.lit(0))).alias("l"), padded(F.coalesce(F.get(sides, F.lit(1)), F.lit(""))).alias("r"), F.contains(text, F.lit("::")).alias("short"))
        form = text.rlike("^[0-9a-f:]+$") & ~text.rlike("[0-9a-f]{5}|:::|::.*::|^:[^:]|[^:]:$")

        def filled(x: Column) -> Column:
            gap = 32 - F.length(x["l"]) - F.length(x["r"])
            return F.when(form & F.when(x["short"], gap >= 4).otherwise(gap == 0), F.concat(x["l"], F.repeat(F.lit("0"), gap), x["r"]))

        return once(both, filled)

    return once(plain, whole)


def _in_v4(number: Column) -> Column:
    def one(net: str) -> Column:
        base, bits = net.split("/")
        first = reduce(lambda n, x: n * 256 + int(x), base.split("."), 0)
        return number.between(first, first + (1 << (32 - int(bits))) - 1)

    return reduce(Column.__or__, map(one, BLOCKED_V4))


def blocked(ip: Column) -> Column:
    """Whether an address lies in a blocked network; IPv4 addresses inside IPv6 ones (mapped, 6to4) count as IPv4. Null if it is none."""

    def judged(x: Column) -> Column:
        v6 = (x["digits"] == "0" * 31 + "1") | x["digits"].rlike("^(f[cd]|fe[89ab])") | x["digits"].startswith("0064ff9b" + "0" * 16)
        inner = F.when(x["digits"].startswith("0" * 20 + "ffff"), F.substring(x["digits"], 25, 8)).when(x["digits"].startswith("2002"), F.substring(x["digits"], 5, 8))
        number = F.coalesce(x["v4"], F.conv(inner, 16, 10).cast("long"))
        return once(number, lambda n: F.when(n.isNotNull(), _in_v4(n)).when(x["digits"].isNotNull(), v6))

    return once(F.struct(v4_number(ip).alias("v4"), v6_digits(ip).alias("digits")), judged)


def refusal(url: Column) -> Column:
    """Why a url may not be fetched: scheme, host, port or address; null if it may as far as its text tells."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    rest = F.regexp_replace(F.regexp_extract(url, r"^[^:]*://([^/?#]*)", 1), "^.*@", "")
    host = F.when(rest.startswith("["), F.regexp_extract(rest, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(rest, "^([^:]*)", 1))
    port = F.regexp_extract(rest, r":(\d+)$", 1)
    port = F.when(rest.rlike(r"^(\[[^\]]*\]|[^:]*):\d+$"), port.try_cast("long"))
    return (
        F.when(url.isNull() | ~scheme.isin("http", "https"), "scheme").when(host == "", "host")
        .when(~F.coalesce(port.isin(*PORTS), port.isNull()), "port").when(F.coalesce(blocked(host), F.lit(False)), "address")
    )
