"""What an address says of the item behind it: platform, post, account, and one form for all its spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Parameters that only say who shared a link, prefixes of hosts, and the forms of addresses by platform, first match first.
TRACKING = r"(?i)^(utm_.*|fbclid|gclid|igshid|igsh|si|s|t|ref|ref_src|ref_url|mibextid|__cft__.*|__tn__|_rdr|rdid|share_url|feature|app|sfnsn|from|wtsid)$"
PREFIXES = ("www", "m", "mbasic", "web", "mobile", "touch", "business")
KINDS = {"facebook": "social", "youtube": "video_platform", "x": "social", "tiktok": "video_platform", "instagram": "social", "telegram": "social", "web": "news"}
_FB, _YT, _TT = r"facebook\.com|fb\.com|fb\.watch", r"youtube\.com|youtu\.be|youtube-nocookie\.com|music\.youtube\.com", r"tiktok\.com|vm\.tiktok\.com|vt\.tiktok\.com"
#: (platform, host, place, canonical form, post, account, video): a place is the path, then | and the parameters story_fbid, id, v and fbid
FORMS = [
    ("facebook", r"fb\.watch", r"/([^/|]+).*", "https://fb.watch/$1", "watch-$1", "", True),
    ("facebook", _FB, r"/(?:permalink|story)\.php\|([^|]+)\|([^|]*).*", "https://www.facebook.com/permalink.php?story_fbid=$1&id=$2", "$1", "$2", False),
    ("facebook", _FB, r"/watch\|[^|]*\|[^|]*\|([^|]+).*", "https://www.facebook.com/watch?v=$1", "$1", "", True),
    ("facebook", _FB, r"/photo(?:\.php)?\|[^|]*\|[^|]*\|[^|]*\|([^|]+)", "https://www.facebook.com/photo?fbid=$1", "$1", "", False),
    ("facebook", _FB, r"/share/(p)/([^/|]+).*", "https://www.facebook.com/share/$1/$2", "share-$2", "", False),
    ("facebook", _FB, r"/share/([vr])/([^/|]+).*", "https://www.facebook.com/share/$1/$2", "share-$2", "", True),
    ("facebook", _FB, r"/reel/([^/|]+).*", "https://www.facebook.com/reel/$1", "$1", "", True),
    ("facebook", _FB, r"/groups/([^/|]+)/(?:posts|permalink)/([^/|]+).*", "https://www.facebook.com/groups/$1/posts/$2", "$2", "groups/$1", False),
    ("facebook", _FB, r"/([^/|]+)/(videos)/(?:[^/|]+/)*([^/|]+)\|.*", "https://www.facebook.com/$1/$2/$3", "$3", "$1", True),
    ("facebook", _FB, r"/([^/|]+)/(posts|photos)/(?:[^/|]+/)*([^/|]+)\|.*", "https://www.facebook.com/$1/$2/$3", "$3", "$1", False),
    ("facebook", _FB, r"/([^/|]+)\|.*", "https://www.facebook.com/$1", "", "$1", False),
    ("facebook", _FB, r"([^|]*)\|.*", "https://www.facebook.com$1", "", "", False),
    ("youtube", r"youtu\.be", r"/([^/|]+).*", "https://www.youtube.com/watch?v=$1", "$1", "", True),
    ("youtube", _YT, r"/watch\|[^|]*\|[^|]*\|([^|]+).*", "https://www.youtube.com/watch?v=$1", "$1", "", True),
    ("youtube", _YT, r"/(?:shorts|live|embed|v)/([^/|]+).*", "https://www.youtube.com/watch?v=$1", "$1", "", True),
    ("youtube", _YT, r"(/(@[^/|]+)[^|]*)\|.*", "https://www.youtube.com$1", "", "$2", True),
    ("youtube", _YT, r"([^|]*)\|.*", "https://www.youtube.com$1", "", "", True),
    ("x", r"x\.com|twitter\.com", r"/([^/|]+)/status/([^/|]+).*", "https://x.com/$1/status/$2", "$2", "@$1", False),
    ("x", r"x\.com|twitter\.com", r"(/([^/|]+)[^|]*)\|.*", "https://x.com$1", "", "@$2", False),
    ("x", r"x\.com|twitter\.com", r"([^|]*)\|.*", "https://x.com$1", "", "", False),
    ("tiktok", _TT, r"/(@[^/|]+)/video/([^/|]+).*", "https://www.tiktok.com/$1/video/$2", "$2", "$1", True),
    ("tiktok", r"vm\.tiktok\.com", r"/([^/|]+).*", "https://vm.tiktok.com/$1", "short-$1", "", True),
    ("tiktok", r"vt\.tiktok\.com", r"/([^/|]+).*", "https://vt.tiktok.com/$1", "short-$1", "", True),
    ("tiktok", _TT, r"([^|]*)\|.*", "https://www.tiktok.com$1", "", "", True),
    ("instagram", r"instagram\.com", r"/(p)/([^/|]+).*", "https://www.instagram.com/$1/$2", "$2", "", False),
    ("instagram", r"instagram\.com", r"/(reel|tv)/([^/|]+).*", "https://www.instagram.com/$1/$2", "$2", "", True),
    ("instagram", r"instagram\.com", r"(/([^/|]+)[^|]*)\|.*", "https://www.instagram.com$1", "", "@$2", False),
    ("instagram", r"instagram\.com", r"([^|]*)\|.*", "https://www.instagram.com$1", "", "", False),
    ("telegram", r"t\.me|telegram\.me", r"/([^/|]+)/([0-9]+)(?:[/|].*)", "https://t.me/$1/$2", "$1/$2", "$1", False),
    ("telegram", r"t\.me|telegram\.me", r"(/([^/|]+)[^|]*)\|.*", "https://t.me$1", "", "$2", False),
    ("telegram", r"t\.me|telegram\.me", r"([^|]*)\|.*", "https://t.me$1", "", "", False),
]


def _plain(part: Column) -> Column:
    return F.coalesce(F.try_url_decode(part), part)


def _quoted(part: Column) -> Column:
    return F.replace(F.replace(F.url_encode(part), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _kept_query(query: Column) -> Column:
    """The parameters that say what a page is, by name: the first value of each, none that are empty or only track."""
    pairs = F.transform(F.filter(F.split(query, "&"), lambda x: x.rlike("^[^=]+=.")), lambda x: F.struct(_plain(F.regexp_extract(x, "^([^=]*)=", 1)).alias("k"), _plain(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v")))
    names = F.transform(pairs, lambda p: p["k"])
    kept = F.filter(pairs, lambda p, i: (F.array_position(names, p["k"]) == i + 1) & ~p["k"].rlike(TRACKING))
    text = F.array_join(F.transform(F.array_sort(kept), lambda p: F.concat(_quoted(p["k"]), F.lit("="), _quoted(p["v"]))), "&")
    return F.when(text != "", F.concat(F.lit("?"), text)).otherwise("")


def with_links(df: DataFrame, url_col: str, link_col: str = "link") -> DataFrame:
    """df and a struct link_col: platform, kind, canonical, opened, domain, post_id, account, video, external_id; null if it is no http(s) address.

    The same post gives the same canonical form, whatever the spelling; pages of no known platform keep their path and meaningful parameters.
    Steps are projections of their own, so that no part of an address is found twice.
    """
    url = F.regexp_replace(url_col, r"^\s+|\s+$", "")
    rows = df.select(F.struct("*").alias("row"), F.when(url.rlike("(?i)^https?://"), url).when(url.rlike(r"(?i)^[\w.-]+\.[a-z]{2,}/"), F.concat(F.lit("https://"), url)).alias("url"))
    rows = rows.select("row", *[F.regexp_extract("url", r"(?s)^([A-Za-z]+)://([^/?#]*)([^?#]*)(?:\?([^#]*))?", k + 1).alias(c) for k, c in enumerate(("scheme", "where", "raw", "query"))])
    host = F.regexp_replace(F.regexp_replace(F.lower("where"), r"^.*@|:.*$", ""), "^" + "".join(rf"(?:{p}\.)?" for p in PREFIXES), "")
    cut = F.regexp_replace("raw", "/+$", "")
    rows = rows.select("row", "scheme", "where", "raw", "query", host.alias("host"), F.when(cut == "", "/").otherwise(cut).alias("path"), _kept_query(F.col("query")).alias("kept"))
    value = lambda name: F.replace(_plain(F.regexp_extract("query", rf"(?:^|&){name}=([^&]+)", 1)), F.lit("|"), F.lit("%7C"))
    known = F.col("host").rlike("^(?:" + "|".join(dict.fromkeys(f[1] for f in FORMS)) + ")$")
    rows = rows.withColumn("place", F.when(known, F.concat_ws("|", F.regexp_replace("path", "/+", "/"), *[value(n) for n in ("story_fbid", "id", "v", "fbid")])))
    number = F.coalesce(*[F.when(F.col("host").rlike(f"^(?:{hosts})$") & F.col("place").rlike(f"^{form}$"), k) for k, (_, hosts, form, *_) in enumerate(FORMS)])
    rows = rows.withColumn("number", F.when(F.col("place").isNotNull(), number))
    forms = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in (("platform", f[0]), ("form", f"^{f[2]}$"), ("canonical", f[3]), ("post", f[4]), ("account", f[5]), ("video", f[6]))]) for f in FORMS])
    rows = rows.withColumn("f", F.when(F.col("number").isNotNull(), F.get(forms, F.col("number"))))
    filled = lambda template: F.regexp_replace(F.col("place"), F.col("f.form"), F.col(f"f.{template}"))
    page = F.concat(F.lit("https://"), "host", "path", "kept")
    rows = rows.withColumns({"post": F.nullif(filled("post"), F.lit("")), "account": F.nullif(filled("account"), F.lit("")), "address": F.coalesce(F.regexp_replace(filled("canonical"), "&id=$", ""), page), "name": F.coalesce("f.platform", F.lit("web"))})
    opened = F.when(F.col("number").isNotNull(), F.col("address")).otherwise(F.concat(F.lower("scheme"), F.lit("://"), "where", "raw", "kept"))
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.col("name")]
    fields = {"platform": F.col("name"), "kind": kind, "canonical": F.col("address"), "opened": opened, "domain": F.col("host"), "post_id": F.col("post"), "account": F.col("account"), "video": F.coalesce("f.video", F.lit(False)), "external_id": F.coalesce(F.concat("name", F.lit(":"), "post"), "address")}
    return rows.select("row.*", F.when(F.col("host").contains("."), F.struct(*[v.alias(k) for k, v in fields.items()])).alias(link_col))
