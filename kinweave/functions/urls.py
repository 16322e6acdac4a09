"""URL identity and kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Platforms on which the path, not the host, names the owner, and social platforms. Their subdomains count too.
SHARED_HOSTS = (
    "blog.naver.com", "bandcamp.com", "notion.site", "notion.so", "linktr.ee", "github.io", "wixsite.com", "cargo.site", "cargocollective.com", "myportfolio.com",
    "weebly.com", "blogspot.com", "sites.google.com", "drive.google.com", "docs.google.com", "tistory.com", "behance.net", "vimeo.com", "youtube.com",
)
SOCIAL_HOSTS = (
    "instagram.com", "facebook.com", "linkedin.com", "x.com", "twitter.com", "threads.net", "threads.com", "tiktok.com",
    "instagr.am", "fb.com", "fb.me", "fb.watch", "t.co", "lnkd.in",
)
VIDEO_HOSTS = ("youtube.com", "youtu.be", "vimeo.com")
REPOSITORY_HOSTS = ("github.com",)


def domain_of(c: Column) -> Column:
    """Host in lower case without ``www.``; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?([^/?#:]+)", 1), r"^www\.", "")


def under(host: Column, hosts: tuple[str, ...]) -> Column:
    """The host is one of ``hosts`` or a subdomain of one."""
    return host.rlike(host_pattern(hosts))


def host_pattern(hosts: tuple[str, ...]) -> str:
    return "^(.*[.])?(" + "|".join(h.replace(".", "[.]") for h in hosts) + ")$"


def link_type(c: Column) -> Column:
    """social, video, repository or website."""
    host = F.regexp_replace(domain_of(c), r"[.]+$", "")
    return F.when(under(host, SOCIAL_HOSTS), "social").when(under(host, VIDEO_HOSTS), "video").when(under(host, REPOSITORY_HOSTS), "repository").otherwise("website")


def url_key(c: Column, shared: tuple[str, ...] = SHARED_HOSTS) -> Column:
    """Identity of a website: its host; on a shared platform host and path, without an index page. No query, no fragment."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"^https?://(?:www\.)?", ""), r"[?#].*$", "")
    host = F.regexp_extract(bare, "^([^/]*)", 1)
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(bare, "^[^/]*/(.*)$", 1), r"index\.(?:html?|php)$", ""), "^/+|/+$", "")
    return F.when(under(host, shared), F.concat(host, F.lit("/"), path)).otherwise(host)


def is_social(c: Column, hosts: tuple[str, ...] = SOCIAL_HOSTS) -> Column:
    return under(domain_of(c), hosts)


def surt(c: Column) -> Column:
    """Sort-friendly form: host parts reversed, then the path."""
    host = F.array_join(F.reverse(F.split(domain_of(c), r"\.")), ",")
    return F.concat(host, F.lit(")"), F.regexp_extract(F.lower(F.trim(c)), r"^(?:[a-z][a-z0-9+.-]*://)?[^/?#]+(/[^?#]*)?", 1))


def detect_kind(c: Column) -> Column:
    """Kind of document a URL leads to, by host and path."""
    u = F.regexp_replace(F.lower(c), r"[?#].*$", "")
    host, path = F.regexp_extract(u, r"^[a-z][a-z0-9+.-]*://([^/]*)", 1), F.regexp_extract(u, r"^(?:[a-z][a-z0-9+.-]*://[^/]*)?(.*)$", 1)
    docs = host == "docs.google.com"
    return (
        F.when((host == "drive.google.com") & path.contains("/folders/"), "gdrive_folder").when(host == "drive.google.com", "gdrive_file")
        .when(docs & path.contains("/document/d/"), "gdoc").when(docs & path.contains("/spreadsheets/d/"), "gsheet")
        .when(path.endswith(".pdf"), "pdf").when(path.endswith(".docx"), "docx").when(path.endswith(".hwp"), "hwp").otherwise("web")
    )


def fetch_target(c: Column) -> Column:
    """Share links of documents, sheets and files as links to the file itself; others unchanged; null where such a link has no id."""
    kind = detect_kind(c)
    part = lambda pat: F.nullif(F.regexp_extract(c, pat, 1), F.lit(""))
    drive = F.coalesce(part(r"/file/d/([A-Za-z0-9_-]+)"), part(r"[?&]id=([^&#]+)"))
    own = F.regexp_replace(c, r"([?&])dl=0", "$1dl=1")
    dropbox = F.when(c.contains("dl="), own).otherwise(F.concat(own, F.when(c.contains("?"), "&dl=1").otherwise("?dl=1")))
    return (
        F.when(kind == "gdrive_file", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive))
        .when(kind == "gdoc", F.concat(F.lit("https://docs.google.com/document/d/"), part(r"/document/d/([A-Za-z0-9_-]+)"), F.lit("/export?format=pdf")))
        .when(kind == "gsheet", F.concat(F.lit("https://docs.google.com/spreadsheets/d/"), part(r"/spreadsheets/d/([A-Za-z0-9_-]+)"), F.lit("/export?format=csv")))
        .when(F.regexp_extract(F.lower(c), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1).contains("dropbox.com"), dropbox).otherwise(c)
    )
