"""URLs as native expressions: canonical forms, identity keys, platforms and boards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Parameters that say where a visitor came from, not which posting it is.
TRACKING = [
    "gh_src", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "source", "lever-origin", "lever-source",
    "src", "jobSite", "iis", "iisn", "in_iframe", "ss",
]
# Hosts by platform, in order.
HOSTS = [
    ("greenhouse.io", "greenhouse"), ("ashbyhq.com", "ashby"), ("lever.co", "lever"), ("myworkdayjobs.com", "workday"), ("linkedin.com", "linkedin"), ("icims.com", "icims"),
    ("bamboohr.com", "bamboo"), ("workable.com", "workable"), ("gem.com", "gem"), ("rippling.com", "rippling"), ("careers.ibm.com", "ibm"), ("taleo.net", "taleo"),
]
# Paths of pages that list openings, and parameters that name one.
INDEX_PATHS = ["careers", "jobs", "open-positions", "openings", "positions", "join(-us)?", "work-with-us", "hiring", "we-are-hiring"]
SPECIFIERS = ["gh_jid", "ashby_jid", "currentJobId"]
# Suffixes of two parts, and labels that are no company's name.
TWO_PART_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "co.jp", "co.in", "co.nz", "co.za", "co.kr", "com.au", "com.br", "com.mx", "com.sg", "com.cn"]
GENERIC_LABELS = ["www", "jobs", "careers", "career", "apply", "job", "boards", "talent"]
UUID = "[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"

_SPLIT = "^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\\?([^#]*))?(?:#.*)?$"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """What the group matched, null if nothing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SPLIT, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 2)


def path(url: Column) -> Column:
    """The path without parameters behind a semicolon in its last segment."""
    return F.regexp_replace(F.regexp_extract(url, _SPLIT, 3), ";[^/]*$", "")


def query(url: Column) -> Column:
    return F.regexp_extract(url, _SPLIT, 4)


def decoded(text: Column) -> Column:
    """Percent-decoded; as it is where that fails."""
    return F.coalesce(F.try_url_decode(text), text)


def parameter(url: Column, name: str) -> Column:
    """The first value of a query parameter that isn't blank, decoded."""
    return F.nullif(decoded(F.regexp_extract(F.concat(F.lit("&"), query(url)), f"[&]{name}=([^&]+)", 1)), F.lit(""))


def _quoted(text: Column) -> Column:
    """Percent-encoded but for letters, digits and _ . - ~, with plus signs for spaces."""
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_url(url: Column) -> Column:
    """Without tracking parameters, fragment and closing slashes (a path of one slash stays); a posting id in gh_jid stands alone, as it reads."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: F.rlike(p, F.lit("^[^=]+=.+$")))
    kept = F.filter(pairs, lambda p: ~decoded(F.substring_index(p, "=", 1)).isin(TRACKING))
    again = lambda x: _quoted(decoded(x))
    encoded = F.array_join(F.transform(kept, lambda p: F.concat(again(F.substring_index(p, "=", 1)), F.lit("="), again(F.substring(p, F.instr(p, "=") + 1, F.length(p))))), "&")
    jid = parameter(url, "gh_jid")
    bare = F.regexp_replace(path(url), "/+$", "")
    at = F.when(jid.isNotNull(), F.coalesce(F.nullif(bare, F.lit("")), F.lit("/"))).when(F.length(path(url)) > 1, bare).otherwise(path(url))
    tail = F.when(jid.isNotNull(), F.concat(F.lit("gh_jid="), jid)).otherwise(encoded)
    head = F.concat(F.when(scheme(url) != "", F.concat(scheme(url), F.lit(":"))).otherwise(""), F.when(netloc(url) != "", F.concat(F.lit("//"), netloc(url))).otherwise(""), at)
    return F.when(url.isNull() | (url == "") | F.startswith(url, F.lit("manual-paste")), url).otherwise(F.concat(head, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")))


def requisition_id(url_path: Column) -> Column:
    """What stands behind the last underscore of the path's last segment, if it has a digit."""
    last = F.element_at(F.split(F.regexp_replace(url_path, "/+$", ""), "/"), -1)
    tail = F.substring_index(last, "_", -1)
    return F.when(F.contains(last, F.lit("_")) & F.rlike(tail, F.lit("[0-9]")), tail)


def dedupe_key(url: Column) -> Column:
    """One key for all addresses of a posting: by the platform's own id, else the canonical address."""
    host, at = netloc(url), path(url)
    stanza = lambda pattern: F.substring_index(_found(at, pattern), "-", 1)
    embedded = F.when(F.startswith(at, F.lit("/embed/job_app")), F.regexp_extract(parameter(url, "token"), "^([0-9]+)$", 1))
    gh = F.coalesce(parameter(url, "gh_jid"), F.when(F.contains(host, F.lit("greenhouse.io")), F.coalesce(_found(at, "^/[^/]+/jobs/(\\d+)/?$"), F.nullif(embedded, F.lit("")))))
    keys = [
        F.concat(F.lit("gh:"), gh),
        F.when(F.contains(host, F.lit("myworkdayjobs.com")), F.concat(F.lit("wd:"), host, F.lit(":"), requisition_id(at))),
        F.when(F.contains(host, F.lit("linkedin.com")), F.concat(F.lit("linkedin:"), F.coalesce(_found(at, "/jobs/view/(\\d+)"), parameter(url, "currentJobId")))),
        F.concat(F.lit("ashby:"), F.substring_index(F.coalesce(parameter(url, "ashby_jid"), F.when(host == "jobs.ashbyhq.com", _found(at, f"(?i)^/[^/]+/({UUID})(?:/.*)?$"))), "-", 1)),
        F.when(host == "jobs.lever.co", F.concat(F.lit("lever:"), stanza(f"(?i)^/[^/]+/({UUID})(?:/.*)?$"))),
        F.when(F.endswith(host, F.lit(".icims.com")), F.concat(F.lit("icims:"), F.substring_index(host, ".", 1), F.lit(":"), _found(at, "^/jobs/(\\d+)/"))),
        F.when(host == "ats.rippling.com", F.concat(F.lit("rippling:"), stanza(f"(?i)^/[^/]+/jobs/({UUID})(?:/.*)?$"))),
        F.when(F.contains(host, F.lit("taleo.net")), F.concat(F.lit("taleo:"), F.lower(parameter(url, "org")), F.lit(":"), parameter(url, "rid"))),
    ]
    return F.when(url.isNull() | (url == "") | F.startswith(url, F.lit("manual-paste")), url).otherwise(F.coalesce(*keys, canonical_url(url)))


def detect_platform(url: Column) -> Column:
    """platform and a map that identifies the board; other and an empty map where nothing matches."""
    entry = lambda *kv: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in kv))
    none = F.create_map().cast("map<string,string>")
    board = _found(url, "(?:job-)?boards\\.greenhouse\\.io/([^/?#]+)")
    board = F.when(board == "embed", parameter(url, "for")).otherwise(board)
    simple = {"lever": ("company", "jobs\\.lever\\.co/([^/?#]+)"), "ashby": ("org", "jobs\\.ashbyhq\\.com/([^/?#]+)"), "rippling": ("slug", "ats\\.rippling\\.com/([^/?#]+)")}
    tenant = F.lower(_found(url, "(?i)(?:^|//)([a-z0-9-]+)\\.icims\\.com"))
    wd = "([a-z0-9-]+\\.[a-z0-9-]+\\.myworkdayjobs\\.com)/([^/?#]+)(?:/([^/?#]+))?"
    host, first, second = (_found(url, wd, k) for k in (1, 2, 3))
    out = lambda name, ident: F.struct(F.lit(name).alias("platform"), ident.cast("map<string,string>").alias("identifier"))
    chain = F.when(board.isNotNull(), out("greenhouse", entry("board", board)))
    for name, (key, pattern) in simple.items():
        chain = chain.when(_found(url, pattern).isNotNull(), out(name, entry(key, _found(url, pattern))))
    chain = chain.when(tenant.isNotNull(), out("icims", entry("tenant", tenant)))
    chain = chain.when(second.isNotNull(), out("workday", entry("host", host, "lang", first, "site", second)))
    return chain.when(host.isNotNull(), out("workday", entry("host", host, "site", first))).otherwise(out("other", none))


def site_candidates(url: Column, landing: Column) -> Column:
    """What may identify a Workday board, likeliest first: host, lang and site by the first two segments of the path, or host and site by the first.

    A first segment that looks like a locale is tried as one first. An address without a path goes by where its root leads (landing), if that is known. Addresses of other hosts have none.
    """
    host = _found(url, "([a-z0-9-]+\\.[a-z0-9-]+\\.myworkdayjobs\\.com)")
    segments = lambda at: F.filter(F.split(F.coalesce(at, F.lit("")), "/"), lambda x: x != "")
    parts = F.when(F.size(segments(path(url))) > 0, segments(path(url))).otherwise(segments(landing))
    first, second = F.get(parts, 0), F.get(parts, 1)
    kind = "array<struct<host:string,lang:string,site:string>>"
    one = F.struct(host.alias("host"), F.lit(None).cast("string").alias("lang"), first.alias("site"))
    two = F.struct(host.alias("host"), first.alias("lang"), second.alias("site"))
    both = F.when(F.rlike(first, F.lit("^[a-z]{2}(-[A-Z]{2})?$")), F.array(two, one)).otherwise(F.array(one, two))
    return F.when(host.isNull() | first.isNull(), F.array().cast(kind)).when(second.isNull(), F.array(one)).otherwise(both).cast(kind)


def resolved_site(candidates: Column, live: Column) -> Column:
    """The first of the candidates that is among those known to answer (an array of the same kind); null if none is."""
    return F.get(F.filter(candidates, lambda c: F.exists(live, lambda x: (x["host"] == c["host"]) & x["lang"].eqNullSafe(c["lang"]) & (x["site"] == c["site"]))), 0)


def host_platform(host: Column) -> Column:
    """The platform of a host name."""
    chain = F.when(F.lit(False), F.lit(""))
    for part, name in HOSTS:
        chain = chain.when(F.contains(host, F.lit(part)), F.lit(name))
    return chain.otherwise(F.lit("unknown"))


def embedded_board(html: Column) -> Column:
    """The address of the first job board that a page embeds, in order of platforms."""
    page = html
    wd = "([a-z0-9-]+\\.[a-z0-9-]+\\.myworkdayjobs\\.com)/([^/\"']+)/([^/?#\"']+)"
    return F.coalesce(
        F.concat(F.lit("https://boards.greenhouse.io/"), F.coalesce(_found(page, "boards\\.greenhouse\\.io/embed/job_board/js\\?for=([^\"'&]+)"), _found(page, "(?:job-)?boards\\.greenhouse\\.io/([a-z0-9_-]+)/jobs"))),
        F.concat(F.lit("https://jobs.ashbyhq.com/"), _found(page, "jobs\\.ashbyhq\\.com/([a-z0-9_-]+)")),
        F.concat(F.lit("https://jobs.lever.co/"), _found(page, "jobs\\.lever\\.co/([a-z0-9_-]+)")),
        F.concat(F.lit("https://"), _found(page, wd, 1), F.lit("/"), _found(page, wd, 2), F.lit("/"), _found(page, wd, 3)),
    )


def careers_url(url: Column) -> Column:
    """The address of the board that a posting is on."""
    host = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":\\d+$", ""))
    segs = F.filter(F.split(path(url), "/"), lambda s: s != "")
    one, two = F.get(segs, 0), F.get(segs, 1)
    site = lambda base, x: F.concat(F.lit(base), x)
    guess = parameter(url, "gh_jid").isNotNull() | F.rlike(path(url), F.lit("(?i)/(jobs?|careers|positions|openings)/.*\\d{5,}/?$"))
    return (
        F.when(scheme(url) == "", F.lit(None).cast("string"))
        .when(F.endswith(host, F.lit("greenhouse.io")) & (one == "embed"), site("https://boards.greenhouse.io/", parameter(url, "for")))
        .when(F.endswith(host, F.lit("greenhouse.io")) & one.isNotNull(), site("https://boards.greenhouse.io/", one))
        .when((host == "jobs.ashbyhq.com") & one.isNotNull(), site("https://jobs.ashbyhq.com/", one))
        .when((host == "jobs.lever.co") & one.isNotNull(), site("https://jobs.lever.co/", one))
        .when(F.endswith(host, F.lit(".myworkdayjobs.com")) & two.isNotNull(), F.concat(F.lit("https://"), host, F.lit("/"), one, F.lit("/"), two))
        .when(F.endswith(host, F.lit(".icims.com")), F.concat(F.lit("https://"), host, F.lit("/jobs/search?ss=1")))
        .when((host == "ats.rippling.com") & one.isNotNull(), F.concat(F.lit("https://ats.rippling.com/"), one, F.lit("/jobs")))
        .when(guess, url)
    )


def registrable_label(host: Column) -> Column:
    """The label before the public suffix; null where a host has none."""
    parts = F.filter(F.split(F.lower(host), "\\."), lambda p: p != "")
    double = F.concat_ws(".", F.get(parts, F.size(parts) - 2), F.get(parts, F.size(parts) - 1)).isin(TWO_PART_SUFFIXES)
    return F.when(F.size(parts) >= 2, F.when(double, F.get(parts, F.size(parts) - 3)).otherwise(F.get(parts, F.size(parts) - 2)))


def board_candidates(host: Column) -> Column:
    """Names that a company's board may have, most likely first; none for hosts that name no company."""
    label = registrable_label(host)
    bare = F.replace(label, F.lit("-"), F.lit(""))
    names = F.array(label, F.concat(label, F.lit("jobs")), bare, F.concat(bare, F.lit("jobs")))
    none = F.array().cast("array<string>")
    return F.when(label.isNull() | label.isin(GENERIC_LABELS), none).otherwise(F.array_distinct(names))


def is_scoreable(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (netloc(url) != ""), F.lit(False))


def is_careers_index(url: Column) -> Column:
    """Whether the page lists openings rather than being one."""
    named = F.lit(False)
    for p in SPECIFIERS:
        named = named | parameter(url, p).isNotNull()
    return F.coalesce(~named & F.rlike(path(url), F.lit(f"(?i)/({'|'.join(INDEX_PATHS)})/?$")), F.lit(False))


def same_origin(url: Column, other: Column) -> Column:
    origin = lambda u: F.concat(scheme(u), F.lit("://"), F.lower(netloc(u)))
    return F.coalesce((netloc(url) != "") & (origin(url) == origin(other)), F.lit(False))


def posting_id(url: Column, platform: Column, row_id: Column) -> Column:
    """A short id for names, by platform; the row's own where there is none."""
    at = path(url)
    last = F.try_element_at(F.filter(F.split(at, "/"), lambda s: s != ""), F.lit(-1))
    gh = F.when(platform == "greenhouse", F.coalesce(parameter(url, "gh_jid"), _found(at, "/jobs/(\\d+)")))
    wd = F.when(platform == "workday", _found(at, "_([A-Z]*\\d+)$"))
    uuid = F.when(platform.isin("ashby", "lever") & F.rlike(at, F.lit("[^/]")), F.substring_index(last, "-", 1))
    return F.coalesce(gh, wd, uuid, row_id.cast("string"))


def url_quote(text: Column) -> Column:
    """Percent-encoded for a path: slashes stay, spaces are %20."""
    return F.replace(F.replace(_quoted(text), F.lit("+"), F.lit("%20")), F.lit("%2F"), F.lit("/"))


def client_key(url: Column) -> Column:
    """The key that the browser client makes: as dedupe_key, but LinkedIn comes first and reads its parameter before the path, hosts are
    compared in lower case and by their ends, and what has no key keeps its slashes and posting ids as any other address.
    """
    host, at = F.lower(F.regexp_replace(F.regexp_replace(netloc(url), "^.*@", ""), ":\\d+$", "")), path(url)
    linked = F.when(F.contains(host, F.lit("linkedin.com")), F.concat(F.lit("linkedin:"), F.coalesce(parameter(url, "currentJobId"), _found(at, "/jobs/view/(\\d+)"))))
    token = F.when(F.startswith(at, F.lit("/embed/job_app")), F.nullif(F.regexp_extract(parameter(url, "token"), "^([0-9]+)$", 1), F.lit("")))
    gh = F.coalesce(parameter(url, "gh_jid"), F.when(F.endswith(host, F.lit("greenhouse.io")), F.coalesce(_found(at, "^/[^/]+/jobs/(\\d+)/?$"), token)))
    wd = F.when(F.endswith(host, F.lit(".myworkdayjobs.com")), F.concat(F.lit("wd:"), host, F.lit(":"), requisition_id(at)))
    stanza = lambda pattern: F.substring_index(_found(at, pattern), "-", 1)
    rest = [
        F.concat(F.lit("ashby:"), F.substring_index(F.coalesce(parameter(url, "ashby_jid"), F.when(host == "jobs.ashbyhq.com", _found(at, f"(?i)^/[^/]+/({UUID})(?:/.*)?$"))), "-", 1)),
        F.when(host == "jobs.lever.co", F.concat(F.lit("lever:"), stanza(f"(?i)^/[^/]+/({UUID})(?:/.*)?$"))),
        F.when(host == "ats.rippling.com", F.concat(F.lit("rippling:"), stanza(f"(?i)^/[^/]+/jobs/({UUID})(?:/.*)?$"))),
        F.when(F.endswith(host, F.lit(".icims.com")), F.concat(F.lit("icims:"), F.substring_index(host, ".", 1), F.lit(":"), _found(at, "^/jobs/(\\d+)/"))),
        F.when(F.contains(host, F.lit("taleo.net")), F.concat(F.lit("taleo:"), F.lower(parameter(url, "org")), F.lit(":"), parameter(url, "rid"))),
    ]
    pairs = F.filter(F.split(query(url), "&"), lambda p: (p != "") & ~decoded(F.substring_index(p, "=", 1)).isin(TRACKING))
    kept = F.array_join(F.transform(pairs, lambda p: F.concat(_quoted(decoded(F.substring_index(p, "=", 1))), F.lit("="), F.when(F.contains(p, F.lit("=")), _quoted(decoded(F.substring(p, F.instr(p, "=") + 1, F.length(p))))).otherwise(""))), "&")
    root = F.when(at == "", F.lit("/")).when(F.length(at) > 1, F.regexp_replace(at, "/+$", "")).otherwise(at)
    plain = F.concat(scheme(url), F.lit("://"), F.lower(F.regexp_replace(netloc(url), "^.*@", "")), root, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(""))
    return F.when(url.isNull() | (url == "") | (scheme(url) == ""), url).otherwise(F.coalesce(linked, F.concat(F.lit("gh:"), gh), wd, *rest, plain))
