"""Links, handles, mail addresses and phone numbers in text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hosts of platforms as they are in the world; a sub-domain belongs to its host.
PLATFORMS = {
    "instagram": ("instagram.com", "instagr.am", "ig.me"), "tiktok": ("tiktok.com",), "youtube": ("youtube.com", "youtu.be"), "facebook": ("facebook.com", "fb.com", "fb.me"), "linkedin": ("linkedin.com", "lnkd.in"),
    "telegram": ("t.me", "telegram.me"), "whatsapp": ("wa.me", "whatsapp.com"), "x": ("x.com", "twitter.com"), "threads": ("threads.net", "threads.com"), "pinterest": ("pinterest.com", "pin.it"),
    "snapchat": ("snapchat.com",), "spotify": ("spotify.com",), "github": ("github.com",), "vimeo": ("vimeo.com",), "linktree": ("linktr.ee",), "calendly": ("calendly.com",),
}
#: Platforms whose links are of the form host/name, and for each the first parts of a path that are no names there.
RESERVED = {
    "instagram": ("about", "accounts", "add", "direct", "explore", "legal", "p", "reel", "reels", "share", "stories", "tv", "web"),
    "tiktok": ("discover", "embed", "live", "music", "search", "t", "tag", "video"),
    "youtube": ("c", "channel", "feed", "hashtag", "live", "playlist", "results", "shorts", "user", "watch"),
    "facebook": ("events", "groups", "hashtag", "help", "login", "marketplace", "pages", "people", "photo", "photos", "profile.php", "reel", "reels", "share", "sharer", "watch"),
    "x": ("explore", "hashtag", "home", "i", "intent", "login", "messages", "search", "settings", "share"),
    "threads": ("login", "search", "t"), "telegram": ("c", "joinchat", "proxy", "s", "share"), "pinterest": ("business", "explore", "ideas", "pin", "search", "today"), "snapchat": ("add", "discover", "spotlight"),
    "github": ("about", "explore", "features", "login", "search", "settings", "topics"), "linktree": ("login", "s"),
}
NAMED = tuple(RESERVED)
#: A mail address: dot-atoms of letters, digits, _ + and -, and a host of labels.
EMAIL = r"([0-9A-Za-z_][0-9A-Za-z_+-]*(?:\.[0-9A-Za-z_+-]+)*@(?:[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?\.)+[A-Za-z]{2,24})"
#: A URL: scheme or www, a host with an optional port, and a rest that doesn't end in a mark of the sentence around it.
URL = r"((?:[Hh][Tt][Tt][Pp][Ss]?://|[Ww][Ww][Ww]\.)[0-9A-Za-z](?:[0-9A-Za-z.-]*[0-9A-Za-z])?(?::[0-9]{1,5})?(?:[/?#](?:[^\s<>\"']*[^\s<>\"'.,;:!?)\]])?)?)"
#: A host without scheme or www counts if it ends in one of these.
ENDS = "com|net|org|info|biz|app|dev|shop|store|site|online|club|page|link|studio|io|co|me|ai|tv|to|ly|be|ee|gl|es|mx|ar|cl|pe|us|de|fr|it|uk|br|ca|eu|ch|at|nl|pt"
BARE = rf"(?:^|[^\p{{L}}\p{{N}}@_./-])((?:[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?\.)+(?:{ENDS})\b(?:/(?:[^\s<>\"']*[^\s<>\"'.,;:!?)\]])?)?)"
#: A handle begins anywhere but inside a word, a mail address or a path.
BEFORE = r"(?:^|[^\p{L}\p{N}_.@/])@[A-Za-z0-9_](?:[A-Za-z0-9_.]{0,28}[A-Za-z0-9_])?"
HANDLE = r"(?:^|[^\p{L}\p{N}_.@/])(@[A-Za-z0-9_](?:[A-Za-z0-9_.]{0,28}[A-Za-z0-9_])?)"
PHONE = r"(\+?[0-9][0-9 ().-]{6,}[0-9])"
#: What a handle is made of behind its @, and what may not stand before that.
NAME, INSIDE = r"^([A-Za-z0-9_](?:[A-Za-z0-9_.]{0,28}[A-Za-z0-9_])?)", r"[\p{L}\p{N}_./]"
#: What stands before a handle, up to so many characters, and words there that name a platform.
CONTEXT = 48
SAID = {
    "instagram": "instagram", "insta": "instagram", "ig": "instagram", "tiktok": "tiktok", "tik tok": "tiktok", "tt": "tiktok", "youtube": "youtube", "yt": "youtube", "canal": "youtube", "facebook": "facebook", "face": "facebook",
    "fb": "facebook", "linkedin": "linkedin", "telegram": "telegram", "twitter": "x", "x": "x", "threads": "threads", "pinterest": "pinterest", "snapchat": "snapchat", "snap": "snapchat", "spotify": "spotify",
}
NAMES = "|".join(SAID)


def host(url: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?([^/?#:]+)", 1)), r"^(?:www|m|mobile)\.", "")


def platform(url: Column) -> Column:
    """The platform whose host, or a sub-domain of it, the url has; else web."""
    of = F.create_map(*(F.lit(x) for name, domains in PLATFORMS.items() for domain in domains for x in (domain, name)))  # hosts of two labels
    return F.coalesce(of[F.substring_index(host(url), ".", -2)], F.lit("web"))


def handle(url: Column) -> Column:
    """@name for the first part of a platform link's path, in lower case, or null; parts such as watch or explore are no names."""
    name = F.lower(F.regexp_extract(url, r"^(?:[A-Za-z]+://)?[^/?#]+/(?:(?:in|company|add|stories)/)?@?([A-Za-z0-9_.-]{2,30})(?:[/?#]|$)", 1))
    reserved = F.create_map(*(x for at, words in RESERVED.items() for x in (F.lit(at), F.array(*(F.lit(w) for w in words)))))
    of = reserved[platform(url)]  # null where links are no names
    return F.when((name != "") & ~F.array_contains(of, name), F.concat(F.lit("@"), name))


def structured(url: Column) -> Column:
    """platform, handle and address of a URL: the host without www and the path without its query, or host/name where the link is a name's."""
    name = handle(url)
    path = F.regexp_extract(url, r"^(?:[A-Za-z]+://)?[^/?#]+([^?#]*?)/*(?:[?#].*)?$", 1)
    return F.struct(platform(url).alias("platform"), name.alias("handle"), F.concat(F.lit("https://"), host(url), F.when(name.isNotNull(), F.concat(F.lit("/"), F.substring(name, 2, 30))).otherwise(path)).alias("address"))


def named_before(context: Column) -> Column:
    """The platform that the last of NAMES in a text names, or null."""
    last = F.lower(F.regexp_extract(context, rf"(?is).*\b({NAMES})\b", 1))
    return F.create_map(*(F.lit(x) for pair in SAID.items() for x in pair))[last]


def public(url: Column) -> Column:
    """Whether a url is http or https with a host that is no local name and no private address."""
    h = F.lower(F.regexp_extract(url, r"^https?://(?:[^/@]*@)?([^/?#:]+)", 1))
    private = r"^(?:localhost|.*\.local|127\.|10\.|0\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.).*"
    return F.coalesce((h != "") & ~h.rlike(private), F.lit(False))


def single(text: Column) -> Column:
    """kind and value of the one link in text: a mail address before a url before a handle before a phone number."""
    found = [(k, F.regexp_extract(text, p, 1)) for k, p in (("email", EMAIL), ("url", URL), ("handle", HANDLE), ("phone", PHONE))]
    out = F.lit(None).cast("struct<kind:string,value:string>")
    for kind, value in reversed(found):
        out = F.when(value != "", F.struct(F.lit(kind).alias("kind"), value.alias("value"))).otherwise(out)
    return out


def digits(phone: Column) -> Column:
    return F.regexp_replace(phone, "[^0-9]", "")


def phone_display(phone: Column) -> Column:
    """Nine digits as 3 3 3, ten as 3 3 4, others as given."""
    d = digits(phone)
    return F.when(F.length(d) == 9, F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 3))).when(F.length(d) == 10, F.concat_ws(" ", F.substring(d, 1, 3), F.substring(d, 4, 3), F.substring(d, 7, 4))).otherwise(phone)


def without(text: Column, pattern: str) -> Column:
    """text with blanks for what the pattern finds: a span that one kind of link has taken is no other's."""
    return F.regexp_replace(text, pattern, " ")


def all_links(rows: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, kind, value, platform, handle, address, ambiguous and n (times) for each different link of a text.

    Mail addresses take their spans before URLs, these before hosts without scheme, these before handles, these before phone numbers of 8 digits or more. A handle belongs to the platform that a word up to CONTEXT characters before
    it names; one without such a word is ambiguous and counts for instagram, unless a sure link of the same text has the handle too: then it is that link's. A null text has none.
    """
    clean, rest, unschemed, last, pieces = (F.col(c) for c in ("_clean", "_rest", "_unschemed", "_last", "_pieces"))
    cleaned = rows.select(*key, F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "@{2,}", "@").alias("_clean")).withColumn("_rest", without(clean, EMAIL))
    cleaned = cleaned.withColumn("_unschemed", without(rest, URL)).withColumn("_last", without(unschemed, BARE)).withColumn("_pieces", F.split(last, "@"))
    every = lambda of, pattern: F.regexp_extract_all(of, F.lit(pattern), F.lit(1))
    link = lambda kind, value, platform, handle, address, ambiguous: F.struct(F.lit(kind).alias("kind"), value.alias("value"), platform.alias("platform"), handle.alias("handle"), address.alias("address"), ambiguous.alias("ambiguous"))
    none, sure = F.lit(None).cast("string"), F.lit(False)

    def of_url(x: Column) -> Column:
        u = structured(x)
        return link("url", x, u["platform"], u["handle"], u["address"], sure)

    def of_handle(before: Column, after: Column) -> Column:
        name, said = F.concat(F.lit("@"), F.lower(F.regexp_extract(after, NAME, 1))), named_before(F.right(before, F.lit(CONTEXT)))
        at = F.coalesce(said, F.lit("instagram"))
        return link("handle", name, at, name, F.concat(F.lit("https://"), at, F.lit("/"), F.substring(name, 2, 30)), said.isNull())

    # a handle is what two pieces have at their ends: linear in the text, whatever it holds
    pairs = F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x, i: F.struct(F.get(pieces, i).alias("before"), x.alias("after")))
    handles = F.filter(pairs, lambda x: ~F.right(x["before"], F.lit(1)).rlike(INSIDE) & x["after"].rlike(NAME))
    found = F.concat(
        F.transform(every(clean, EMAIL), lambda x: link("email", F.lower(x), F.lit("email"), none, F.concat(F.lit("mailto:"), F.lower(x)), sure)),
        F.transform(every(rest, URL), of_url),
        F.transform(every(unschemed, BARE), of_url),
        F.transform(handles, lambda x: of_handle(x["before"], x["after"])),
        F.transform(F.filter(every(without(last, BEFORE), PHONE), lambda x: F.length(digits(x)) >= 8), lambda x: link("phone", x, F.lit("phone"), none, F.concat(F.lit("tel:+"), digits(x)), sure)),
    )
    links = cleaned.select(*key, F.explode(found).alias("_l")).select(*key, "_l.*")
    sure_too = F.max(F.col("handle").isNotNull() & ~F.col("ambiguous")).over(Window.partitionBy(*key, "handle"))
    kept = links.withColumn("_sure", sure_too).where("not ambiguous or not _sure").drop("_sure")
    return kept.groupBy(*key, "kind", "platform", "handle", "address", "ambiguous").agg(F.min("value").alias("value"), F.count("*").alias("n"))
