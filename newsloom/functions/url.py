"""Column expressions over URL strings (no URL parser: regular expressions keep codegen whole)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsloom.functions.binding import let
from newsloom.functions.text import match_text

# --- fixed values: must equal the published behaviour for results to match -------------------
TRACKING_PARAMS = [
    "fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "yclid", "twclid", "igshid", "mc_cid", "mc_eid",
    "ref", "ref_src", "ref_url", "referrer", "cmpid", "cmp", "icid", "ito", "itm_source", "itm_medium",
    "itm_campaign", "ncid", "ocid", "sr_share", "share", "shared", "from", "source", "via", "amp",
    "outputtype", "originurl", "_ga", "_gl", "hl", "spm", "ftag", "pfrom", "utm",
]
TRACKING_PREFIXES = ["utm_", "at_", "pk_", "mtm_", "hsa_", "oly_", "vero_", "__"]
HOST_PREFIXES = ["www", "m", "amp", "mobile"]
RESERVED_SUFFIXES = "localhost|local|internal|intranet|lan|home|corp|localdomain|invalid|test|example"
URL_MAX = 2048
# ---------------------------------------------------------------------------------------------


_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{2,}([^/?#\\]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.\-]*:[/\\]{2,}[^/?#\\]*([^?#]*)"
_QUERY = r"^[^?#]*\?([^#]*)"
_FRAGMENT = r"(#.*)$"
_UNSAFE_IN_PATH = "[^!-~]|[\"<>`{}^]"
_UNSAFE_IN_QUERY = "[^!-~]|[\"<>']"


def _escape_chars(text: Column, unsafe: str) -> Column:
    def one(c: Column) -> Column:
        return F.when(c.rlike(unsafe), F.replace(F.url_encode(c), F.lit("+"), F.lit("%20"))).otherwise(c)

    return let(
        text,
        lambda v: F.when(v.rlike(unsafe), F.array_join(F.transform(F.split(v, ""), one), "")).otherwise(v),
    )


def _browser_path(raw: Column) -> Column:
    # Dot segments go away at any depth, written out or as %2e; the path is never empty.
    def undotted(p: Column) -> Column:
        parts = F.split(p, "/", -1)
        last = F.size(parts) - 1
        named = F.transform(parts, lambda part, i: F.struct(part.alias("part"), F.replace(F.lower(part), F.lit("%2e"), F.lit(".")).alias("dots"), (i == last).alias("last")))

        def step(stack: Column, x: Column) -> Column:
            up = F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0)))
            kept = F.when(x.dots == "..", up).when(x.dots == ".", stack).otherwise(F.array_append(stack, x.part))
            return F.when(x.dots.isin(".", "..") & x.last, F.array_append(kept, F.lit(""))).otherwise(kept)

        # The path starts with a slash, so its first part is empty and stays below the stack.
        rest = F.aggregate(F.slice(named, F.lit(2), F.greatest(last, F.lit(0))), F.array().cast("array<string>"), step)
        return F.when(p.startswith("/"), F.concat(F.lit("/"), F.array_join(rest, "/"))).otherwise(p)

    plain = let(F.translate(raw, "\\", "/"), lambda p: F.when(p.rlike(r"(?i)/(\.|%2e)"), undotted(p)).otherwise(p))
    return _escape_chars(let(plain, lambda p: F.when(p == "", "/").otherwise(p)), _UNSAFE_IN_PATH)


def url_parts(url: Column) -> Column:
    """``struct<scheme,authority,host,port,path,query,fragment,length>`` as a browser sees a URL.

    The host is lower case, the port is empty when it is the scheme's default, the path has its
    unsafe characters escaped. Text that is no URL has an empty scheme.
    """

    def split_up(u: Column) -> Column:
        return F.struct(
            F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(u, _AUTHORITY, 1).alias("authority"),
            _browser_path(F.regexp_extract(u, _PATH, 1)).alias("path"),
            F.regexp_extract(u, _QUERY, 1).alias("query"),
            F.regexp_extract(u, _FRAGMENT, 1).alias("fragment"),
        )

    def with_host(p: Column) -> Column:
        port = F.regexp_extract(p.authority, ":0*([0-9]*)$", 1)
        default = F.when(p.scheme == "http", "80").when(p.scheme == "https", "443").otherwise("")
        return F.struct(
            p.scheme.alias("scheme"), p.authority.alias("authority"), p.path.alias("path"), p.query.alias("query"),
            p.fragment.alias("fragment"),
            F.lower(F.regexp_replace(F.regexp_replace(p.authority, "^.*@", ""), ":[0-9]*$", "")).alias("host"),
            F.when(port == default, "").otherwise(port).alias("port"),
            F.length(url).alias("length"),
        )

    # Browsers drop tabs and line breaks anywhere and blanks at both ends.
    trimmed = F.regexp_replace(F.regexp_replace(url, r"[\t\n\r]+", ""), r"^[\u0000- ]+|[\u0000- ]+$", "")
    return let(let(trimmed, split_up), with_host)


def public_url_reason_of(p: Column) -> Column:
    web = p.scheme.isin("http", "https")
    octet = r"(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"

    def reason(host: Column) -> Column:
        bad_host = (host == "") | host.rlike(r"[\s<>^|%\u0000-\u001f]") | (
            ~host.startswith("[") & host.contains(":")
        )
        numeric = host.rlike(r"(^|\.)[0-9]+$")
        ipv4 = host.rlike(rf"^({octet}\.){{3}}{octet}$")
        return (
            F.when(p.scheme.isNull() | (p.scheme == ""), "unparseable URL")
            .when(~web, "unsupported scheme")
            .when(bad_host | (numeric & ~ipv4) | (F.length(p.port) > 5), "unparseable URL")
            .when(p.authority.contains("@") & ~p.authority.rlike("^:?@"), "credentials in URL")
            .when(host.startswith("["), "IP address host")
            .when(~host.contains("."), "host is not a public domain")
            .when(ipv4, "IP address host")
            .when(host.rlike(r"(^|\.)(" + RESERVED_SUFFIXES + ")$"), "non-public host")
            .when(~p.port.isin("", "80", "443"), "non-standard port")
            .when(p.length > URL_MAX, "URL too long")
        )

    return let(F.regexp_replace(p.host, r"\.$", ""), reason)


def strip_host_prefix(host: Column) -> Column:
    """``www.m.site.org`` -> ``site.org``; never leaves fewer than two labels."""
    h = F.regexp_replace(F.lower(host), r"\.$", "")
    return F.regexp_replace(h, r"^(?:(?:" + "|".join(HOST_PREFIXES) + r")\.)+(?=[^.]+\.[^.]+)", "")


def is_tracking(name: Column) -> Column:
    n = F.lower(name)
    return n.isin(*TRACKING_PARAMS) | n.rlike("^(" + "|".join(TRACKING_PREFIXES) + ")")


def _form_decode(text: Column) -> Column:
    return let(text, lambda v: F.coalesce(F.try_url_decode(v), F.replace(v, F.lit("+"), F.lit(" "))))


def query_pairs(query: Column) -> Column:
    """``array<struct<k,v>>`` of decoded query parameters in their original order."""
    pieces = F.filter(F.split(query, "&"), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            _form_decode(F.substring_index(p, "=", 1)).alias("k"),
            _form_decode(F.when(p.contains("="), p.substr(F.locate("=", p) + 1, F.length(p))).otherwise("")).alias("v"),
        ),
    )


def _untracked(pairs: Column) -> Column:
    return F.filter(pairs, lambda p: ~is_tracking(p.k))


def _serialise(pairs: Column) -> Column:
    return F.array_join(F.transform(pairs, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v))), "&")


# Characters a percent-encoder for whole URIs leaves alone (besides letters, digits, - _ . *).
_URI_PLAIN = ";,/?:@&=+$!~'()#"


def _normalise_escapes(path: Column) -> Column:
    """Unescape what needs no escape and re-escape the rest in upper case; bad escapes stay."""

    def encoded(decoded: Column) -> Column:
        e = F.replace(F.url_encode(decoded), F.lit("+"), F.lit("%20"))
        for c in _URI_PLAIN:
            e = F.replace(e, F.lit("%%%02X" % ord(c)), F.lit(c))
        return F.when(~decoded.contains("\ufffd"), e)

    def rewritten(p: Column) -> Column:
        guarded = F.regexp_replace(p, r"(?i)%(?=3B|2F|3F|3A|40|26|3D|2B|24|2C|23)", "%25")
        return F.coalesce(let(F.try_url_decode(F.replace(guarded, F.lit("+"), F.lit("%2B"))), encoded), p)

    return let(path, lambda p: F.when(p.contains("%"), rewritten(p)).otherwise(p))


def _without_amp(path: Column) -> Column:
    # AMP variants and index pages of the same article, in this order.
    def first_segment_gone(p: Column) -> Column:
        at = F.regexp_instr(p, F.lit("(?i)/amp/"))
        return F.when(
            p.rlike("(?i)/amp/"), F.concat(F.substring(p, F.lit(1), at), p.substr(at + 5, F.length(p)))
        ).otherwise(p)

    p = let(F.regexp_replace(path, r"(?i)/amp/?$", "/"), first_segment_gone)
    p = F.regexp_replace(p, r"(?i)\.amp(\.html?)?$", "$1")
    return F.regexp_replace(F.regexp_replace(p, r"(?i)/index\.(html?|php)$", "/"), "/+$", "")


def canonical_url_of(p: Column) -> Column:
    path = _without_amp(_normalise_escapes(F.regexp_replace(p.path, "/{2,}", "/")))
    query = let(
        F.array_sort(_untracked(query_pairs(p.query))),
        lambda kept: F.when(F.size(kept) > 0, F.concat(F.lit("?"), _serialise(kept))).otherwise(""),
    )
    return F.concat(strip_host_prefix(p.host), path, query)


def _rebuilt(p: Column, query: Column, fragment: Column) -> Column:
    return F.concat(
        p.scheme, F.lit("://"), p.host,
        F.when(p.port == "", "").otherwise(F.concat(F.lit(":"), p.port)),
        p.path,
        let(query, lambda q: F.when(q == "", "").otherwise(F.concat(F.lit("?"), q))),
        fragment,
    )


def clean_original_url_of(p: Column) -> Column:
    def new_query(pairs: Column) -> Column:
        return let(
            _untracked(pairs),
            lambda kept: F.when(F.size(kept) == F.size(pairs), _escape_chars(p.query, _UNSAFE_IN_QUERY)).otherwise(
                _serialise(kept)
            ),
        )

    return _rebuilt(p, let(query_pairs(p.query), new_query), F.lit(""))


def image_url_of(p: Column) -> Column:
    return F.when(public_url_reason_of(p).isNull(), _rebuilt(p, p.query, p.fragment))


def url_words_of(p: Column) -> Column:
    """Decoded path and raw query; null for a bad URL or a bad escape."""
    decoded = F.try_url_decode(F.replace(p.path, F.lit("+"), F.lit("%2B")))
    return let(
        decoded,
        lambda d: F.when(
            (p.scheme != "") & ~d.contains("\ufffd"),
            F.concat(d, F.lit(" ?"), _escape_chars(p.query, "[^!-~]")),
        ),
    )


# --- the same over a URL string --------------------------------------------------------------

def public_url_reason(url: Column) -> Column:
    """Null for a public http(s) URL, else why it is refused."""
    return let(url_parts(url), public_url_reason_of)


def canonical_host(url: Column) -> Column:
    return strip_host_prefix(url_parts(url).host)


def canonical_url(url: Column) -> Column:
    """Identity of an article: scheme, fragment, tracking, AMP and index pages removed."""
    return let(url_parts(url), canonical_url_of)


def clean_original_url(url: Column) -> Column:
    """Clickable URL: only tracking parameters and the fragment are dropped."""
    return let(url_parts(url), clean_original_url_of)


def image_url_or_null(url: Column) -> Column:
    """The image URL when it is public, else null."""
    return let(url_parts(url), image_url_of)


def url_path(url: Column) -> Column:
    return url_parts(url).path


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[\u0000- ]*([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def url_match_text(url: Column) -> Column:
    """Words of the decoded path and the raw query; empty for a bad URL or a bad escape."""
    return match_text(let(url_parts(url), url_words_of))
