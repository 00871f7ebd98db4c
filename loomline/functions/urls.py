"""Functions of URLs, by patterns so that no URL is invalid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: (substrings of the path, of which one must be there; words they stand for)
PATH_FEATURES = (((".pdf",), "pdf document"), (("/pubs/",), "publications pubs"), (("/techrpts/", "techrpt"), "technical tech report reports"), (("/homepages/",), "homepages homepage people"), (("/faculty/",), "faculty people"))
#: (page type, substrings of the URL, pattern) in order.
PAGE_TYPES = (("contact", ("/contact", "/visiting"), None), ("academics", ("/academics/",), None), ("people", ("/people/",), None), ("news", ("/news/",), r"/20\d{2}/"), ("about", ("/about/",), None), ("connect", ("/connect/",), None), ("research", ("/research/",), None))
#: Flags of a URL by substrings.
FAMILIES = {"contact": ("/contact", "/about/visiting", "/resources/visiting"), "people": ("/people/", "/staff/", "/leadership"), "homepage": ("/faculty/homepages/",), "report": ("/pubs/techrpts/",), "publication": ("/pubs/", "/faculty/publications"), "news": ("/news/", "/category/news/"), "book": ("/book/",)}


def host(url: Column) -> Column:
    """The host in small letters, without user and port."""
    full = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(F.regexp_replace(full, r"^.*@", ""), r":.*$", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def path_terms(url: Column) -> Column:
    return F.array_join(F.filter(F.split(path(url), r"[/_.\-]+"), lambda p: p != ""), " ")


def host_terms(url: Column, legacy_label: str = "www2", home_labels: tuple[str, ...] = ()) -> Column:
    """Labels of the host; a legacy host and the home domain add words of their own."""
    parts = F.filter(F.split(host(url), r"[.\-]+"), lambda p: p != "")
    out = F.concat(parts, F.when(F.array_contains(parts, legacy_label), F.array(F.lit("legacy"), F.lit("legacy_site"))).otherwise(F.array().cast("array<string>")))
    if home_labels:
        home = F.array(*[F.lit(x) for x in home_labels])
        out = F.concat(out, F.when(F.size(F.array_intersect(parts, home)) == len(home_labels), home).otherwise(F.array().cast("array<string>")))
    return F.array_join(out, " ")


def features(url: Column) -> Column:
    low = F.lower(path(url))
    marks = []
    for cues, named in PATH_FEATURES:
        test = F.lit(False)
        for cue in cues:
            test = test | F.contains(low, F.lit(cue))
        marks.append(F.when(test, F.lit(named)))
    return F.concat_ws(" ", *marks)


def page_type(url: Column) -> Column:
    out = None
    for name, cues, pattern in PAGE_TYPES:
        test = F.lit(False)
        for cue in cues:
            test = test | F.contains(url, F.lit(cue))
        if pattern:
            test = test | url.rlike(pattern)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out.otherwise("general")


def family(url: Column, name: str) -> Column:
    low, test = F.lower(url), F.lit(False)
    for cue in FAMILIES[name]:
        test = test | F.contains(low, F.lit(cue))
    return test


def key(url: Column) -> Column:
    """URL without slashes at its end."""
    return F.regexp_replace(url, "/+$", "")


def slug_title(url: Column, home_title: str = "Home") -> Column:
    """The last part of the path as a title."""
    from loomline.functions.text import title_case

    last = F.element_at(F.split(key(url), "/"), -1)
    plain = (last == "") | (last == host(url))
    return F.when(plain, F.lit(home_title)).otherwise(title_case(F.trim(F.regexp_replace(last, "[-_]+", " "))))
