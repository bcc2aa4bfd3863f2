"""Media reference extraction and formatting as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from colloquia import fixed_values as fv
from colloquia.functions.text import sanitize_snippet, trim_space

_ALL = "|".join([*fv.IMAGE_EXTENSIONS, *fv.VIDEO_EXTENSIONS, *fv.AUDIO_EXTENSIONS, *fv.DOC_EXTENSIONS])
_SEEN = "|".join([*fv.IMAGE_EXTENSIONS, *fv.VIDEO_EXTENSIONS])
LOCAL_PATH = rf"""(?i)([A-Za-z]:\\[^\x00-\x1f"'<>|]+?\.(?:{_ALL}))"""
FILE_TOKEN = rf"(?i)((?:\{{?[a-f0-9]{{8}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{4}}-[a-f0-9]{{12}}\}}?|[a-f0-9]{{32}})\.(?:{_ALL}))"
MEDIA_REF = "source string, kind string, extension string, hash string, file_name string, local_path string, url string"


def media_kind(extension: Column, path: Column) -> Column:
    ext = F.lower(F.regexp_replace(extension, r"^\.", ""))
    low = F.lower(path)
    return (F.when(low.rlike(r"[\\/]emoji[\\/]"), "emoji").when(ext.isin(fv.AUDIO_EXTENSIONS) | low.rlike(r"[\\/]ptt[\\/]"), "audio")
            .when(ext.isin(fv.VIDEO_EXTENSIONS), "video").when(ext.isin(fv.IMAGE_EXTENSIONS), "image").otherwise("file"))


def _ref(source: str, kind: Column, extension: Column, digest: Column, name: Column, path: Column, url: Column) -> Column:
    return F.struct(F.lit(source).alias("source"), kind.alias("kind"), extension.alias("extension"), digest.alias("hash"),
                    name.alias("file_name"), path.alias("local_path"), url.alias("url"))


def media_refs(c: str | Column) -> Column:
    """Local paths, then file tokens, then media links of a body, structural repeats dropped."""
    text = F.col(c) if isinstance(c, str) else c
    none = F.lit(None).cast("string")

    def from_path(raw: Column) -> Column:
        path = trim_space(F.regexp_replace(F.regexp_replace(raw, fv.BODY_KEEP, ""), "[，。！？、；：）)]+$", ""))
        ext = F.concat(F.lit("."), F.lower(F.regexp_extract(path, rf"(?i)\.({_ALL})$", 1)))
        digest = F.nullif(F.lower(F.regexp_extract(path, "[a-fA-F0-9]{32}", 0)), F.lit(""))
        return _ref("localPath", media_kind(ext, path), ext, digest, F.element_at(F.split(path, r"[\\/]"), -1), path, none)

    def from_token(raw: Column) -> Column:
        bare = F.regexp_replace(raw, r"[{}]", "")
        ext = F.concat(F.lit("."), F.lower(F.regexp_extract(bare, r"\.([A-Za-z0-9]+)$", 1)))
        digest = F.lower(F.regexp_replace(F.regexp_replace(bare, r"\.[A-Za-z0-9]+$", ""), "-", ""))
        return _ref("fileToken", media_kind(ext, F.lit("")), ext, digest, bare, none, none)

    def from_url(raw: Column) -> Column:
        ext = F.concat(F.lit("."), F.lower(F.regexp_extract(raw, rf"(?i)\.({_SEEN})(?:[?#].*)?$", 1)))
        return _ref("url", media_kind(ext, F.lit("")), ext, none, none, none, raw)

    urls = F.regexp_extract_all(text, F.lit("(?i)" + fv.URL), F.lit(1))
    paths = F.filter(F.transform(F.regexp_extract_all(text, F.lit(LOCAL_PATH), F.lit(1)), from_path), lambda r: r["extension"] != ".")
    found = F.concat(paths, F.transform(F.regexp_extract_all(text, F.lit(FILE_TOKEN), F.lit(1)), from_token),
                     F.transform(F.filter(urls, lambda u: u.rlike(rf"(?i)\.({_SEEN})(?:[?#].*)?$")), from_url))
    return F.array_distinct(found)


def media_text(refs: Column, snippet: Column) -> Column:
    """Kinds as a list text, and the caption: readable snippet, else the first file name."""
    names = F.filter(F.transform(refs, lambda r: r["file_name"]), lambda n: F.length(n) > 0)
    clean = sanitize_snippet(snippet)
    return F.struct(F.array_join(F.array_distinct(F.transform(refs, lambda r: r["kind"])), ",").alias("kinds"),
                    F.when(F.length(clean) >= 2, clean).otherwise(F.coalesce(F.get(names, F.lit(0)), F.lit(""))).alias("text"))


def format_refs(refs: Column) -> Column:
    """``kind:name`` list; names differing only in case count once, in their last spelling."""
    name = lambda r: F.coalesce(r["file_name"], r["hash"], r["url"], F.lit("unknown"))
    labels = F.transform(refs, lambda r: F.struct(F.concat(r["kind"], F.lit(":"), F.lower(name(r))).alias("k"), F.concat(r["kind"], F.lit(":"), name(r)).alias("l")))
    keys = F.array_distinct(F.transform(labels, lambda x: x["k"]))
    return F.array_join(F.transform(keys, lambda k: F.element_at(F.filter(labels, lambda x: x["k"] == k), -1)["l"]), "; ")


def reply_media(refs: Column) -> Column:
    """Images and files of a reply with a proper hash or a name."""
    def clean(r: Column) -> Column:
        low = F.lower(r["hash"])
        return F.struct(r["kind"].alias("kind"), F.when(low.rlike("^[a-f0-9]{32}$"), low).alias("hash"), trim_space(F.coalesce(r["file_name"], F.lit(""))).alias("file_name"))

    kept = F.transform(F.filter(refs, lambda r: F.coalesce(r["kind"].isin("image", "file"), F.lit(False))), clean)
    return F.filter(kept, lambda r: r["hash"].isNotNull() | (r["file_name"] != ""))


def presentation(c: str | Column) -> Column:
    path = F.split(F.col(c) if isinstance(c, str) else c, "[?#]")[0]
    ext = F.lower(F.element_at(F.split(path, r"\."), -1))
    return F.when(ext.isin(fv.WEB_IMAGES), "image").when(ext.isin(fv.WEB_VIDEOS), "video").otherwise("file")
