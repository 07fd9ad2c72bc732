"""URL expressions. Parts are cut by patterns, so that what is no URL gives nulls or empty parts and never fails."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import text

_PARTS = r"^\s*(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
#: Hosts of videos.
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com", "ted.com")
#: Image types by extension.
IMAGE_TYPES = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp"}


def _part(url: Column | str, i: int) -> Column:
    return F.regexp_extract(F.trim(text(url)), _PARTS, i)


def scheme(url):
    return F.lower(_part(url, 1))


def netloc(url):
    return F.lower(_part(url, 2))


def host(url):
    """Lower case, without user and port."""
    return F.regexp_replace(F.regexp_replace(netloc(url), r"^.*@", ""), r":\d*$", "")


def path(url):
    return _part(url, 3)


def query(url):
    return _part(url, 4)


def fragment(url):
    return _part(url, 5)


def sorted_query(url):
    """Pairs of the query in order, blank ones dropped."""
    return F.array_join(F.array_sort(F.filter(F.split(query(url), "&"), lambda x: x != "")), "&")


def normalize(url):
    """Scheme (https if none) and host in lower case, single slashes, no trailing one, sorted query, no fragment."""
    p = F.regexp_replace(path(url), "/{2,}", "/")
    p = F.when(F.coalesce(p, F.lit("")).isin("", "/"), "/").otherwise(F.regexp_replace(p, "/+$", ""))
    s = F.when(scheme(url) == "", "https").otherwise(scheme(url))
    q = sorted_query(url)
    return F.concat(s, F.lit("://"), netloc(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))


def clean(url):
    """Repairs ' e x=' to '&x=' and further question marks to '&'."""
    fixed = F.regexp_replace(F.trim(text(url)), r"\s+e\s+(?=[A-Za-z_]+=)", "&")
    head = F.split_part(fixed, F.lit("?"), F.lit(1))
    rest = F.substr(fixed, F.length(head) + 2)
    return F.when(F.instr(fixed, "?") == 0, fixed).otherwise(F.concat(head, F.lit("?"), F.replace(rest, F.lit("?"), F.lit("&"))))


def is_http(url):
    return F.lower(F.trim(text(url))).rlike("^https?://")


def is_pdf(url):
    return F.lower(path(url)).endswith(".pdf")


def in_domain(url, domain: str):
    """The host is the domain or below it."""
    return (host(url) == domain) | host(url).endswith(f".{domain}")


def is_video(url, title):
    t = F.lower(text(title))
    return netloc(url).rlike("|".join(x.replace(".", r"\.") for x in VIDEO_HOSTS)) | t.contains("video") | t.contains("vídeo")


def youtube_id(url):
    """The video's id in the known forms of a link; null for others."""
    q = F.regexp_extract(F.concat(F.lit("&"), query(url)), r"&v=([A-Za-z0-9_-]{6,})", 1)
    p = F.regexp_extract(path(url), r"^/(?:embed|shorts|live|v)/([A-Za-z0-9_-]{6,})", 1)
    short = F.regexp_extract(path(url), r"^/([A-Za-z0-9_-]{6,})", 1)
    found = F.when(in_domain(url, "youtu.be"), short).when(in_domain(url, "youtube.com"), F.when(q != "", q).otherwise(p)).otherwise("")
    return F.nullif(found, F.lit(""))


def youtube_watch_url(url):
    return F.concat(F.lit("https://www.youtube.com/watch?v="), youtube_id(url))


def is_youtube_playlist(url):
    return in_domain(url, "youtube.com") & (path(url).rlike("^/playlist/?$") | (query(url).rlike("(^|&)list=") & (youtube_id(url).isNull())))


def github_raw_pdf(url):
    """The raw address of a PDF that is shown on a repository's page; null for others."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    ok = (host(url) == "github.com") & (F.size(parts) >= 5) & (F.get(parts, F.lit(2)) == "blob") & F.lower(F.element_at(F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(""))), -1)).endswith(".pdf")
    return F.when(ok, F.concat(F.lit("https://raw.githubusercontent.com/"), F.concat_ws("/", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.array_join(F.slice(parts, 5, 1000), "/"))))


def caption_as_vtt(url):
    """A caption link that asks for WebVTT."""
    u = text(url)
    has = F.concat(F.lit("&"), query(u)).rlike("&fmt=")
    joiner = F.when(query(u) == "", F.lit("?")).otherwise(F.lit("&"))
    return F.when(has, F.regexp_replace(u, r"([?&])fmt=[^&#]*", "$1fmt=vtt")).otherwise(F.concat(u, joiner, F.lit("fmt=vtt")))


def image_mime_type(url):
    ext = F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))
    known = F.create_map(*(F.lit(x) for kv in IMAGE_TYPES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, ext), F.lit("image/png"))


def image_label(alt, url):
    """The alternative text, else the last part of the path, else the URL."""
    base = F.element_at(F.split(path(url), "/"), -1)
    return F.when(F.trim(text(alt)) != "", F.trim(text(alt))).when(base != "", base).otherwise(text(url))


def route(url, title, resource_code):
    """book, video or article: the first that matches."""
    return F.when(netloc(url).contains("sophia.com.br") | (F.trim(text(resource_code)) != ""), "book").when(is_video(url, title), "video").otherwise("article")


def page_data_url(url):
    """Where a site made of page data keeps that of a page."""
    p = F.regexp_replace(path(url), "/+$", "")
    return F.concat(scheme(url), F.lit("://"), netloc(url), F.lit("/page-data"), F.when(p == "", "/").otherwise(p), F.lit("/page-data.json"))


def first_url(c):
    """The first address in a text, without the punctuation after it; null if there is none."""
    found = F.regexp_replace(F.regexp_extract(text(c), r"(https?://[^\s\"'<>]+)", 1), r"[),.;]+$", "")
    return F.nullif(found, F.lit(""))


#: Kinds of images that models are not sent.
UNSUPPORTED_IMAGES = ("svg", "bmp")


def is_supported_image(url):
    return ~F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1)).isin(*UNSUPPORTED_IMAGES)


def normalize_remote(url):
    """Of an http(s) address: scheme and host in lower case, single slashes, a sorted query, no parameters or fragment. Others as they are."""
    q = sorted_query(url)
    p = F.regexp_replace(F.regexp_replace(F.coalesce(F.nullif(path(url), F.lit("")), F.lit("/")), r";[^/]*$", ""), "/{2,}", "/")
    made = F.concat(scheme(url), F.lit("://"), netloc(url), p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
    return F.when(scheme(url).isin("http", "https"), made).otherwise(F.trim(text(url)))


def media_source(url):
    """What a model is given as a video's address: the plain form of a video on YouTube, others as they are."""
    return F.coalesce(youtube_watch_url(url), text(url))


def is_translated(url):
    """A caption track that asks for a translation."""
    return F.regexp_extract(F.concat(F.lit("&"), query(url)), r"&tlang=([^&]+)", 1) != ""
