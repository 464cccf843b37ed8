"""String expressions: path tokens, slugs, natural order, URIs and escapes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Tokens that mark degraded copies, passes without colour, and full-resolution originals.
DEGRADED = r"^(lr\d*|lq|low|lowres|bicubic|bix\d|bdx\d|lrbi|lrbd|x\d|blur|blurred|noisy|compressed|jpeg)$"
NOT_COLOUR = (
    "occlusions occlusion invalid flow flow_viz viz mask masks depth albedo shading disparities segmentation "
    "camdata camdata_left edges normals seg"
).split()
ORIGINAL = "hr gt original groundtruth".split()
#: Characters that a typesetter reads as commands, and what prints them.
TYPESET = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}


def tokens(text: Column) -> Column:
    """Lower-case parts between runs of ``_``, ``-``, ``.`` and white space."""
    return F.filter(F.split(F.lower(text), "[_\\-\\s.]+"), lambda x: x != "")


def file_stem(name: Column) -> Column:
    """A file name without its last extension; a leading dot starts no extension."""
    return F.regexp_replace(name, "(?<=.)\\.[^.]*$", "")


def path_tokens(path: Column) -> Column:
    """Tokens of all parts of a relative path, the last one without its extension."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    last = F.array(file_stem(F.element_at(parts, -1)))
    return F.flatten(F.transform(F.concat(folders, last), tokens))


def is_clean(token_list: Column) -> Column:
    """No token marks a degraded copy or a pass without colour."""
    return ~F.exists(token_list, lambda x: x.rlike(DEGRADED) | x.isin(NOT_COLOUR))


def natural_key(text: Column) -> Column:
    """A string that sorts as the text does when its digit runs compare as numbers of up to 20 digits."""
    runs = F.regexp_extract_all(F.lower(text), F.lit("(\\d+|\\D+)"), 1)
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike("^\\d"), F.lpad(x, 20, "0")).otherwise(x)), "")


def slug(text: Column) -> Column:
    """Lower case with every run of other characters than a-z, 0-9, ``-`` and ``_`` as one ``_``, trimmed."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9_-]+", "_"), "^_+|_+$", "")


def escape_chars(text: Column, table: Mapping[str, str] = TYPESET) -> Column:
    """Each character replaced by what ``table`` has for it. Texts without any such character are left alone."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    some = "[" + "".join("\\" + c for c in table) + "]"
    return F.when(~text.rlike(some), text).otherwise(F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(pairs[c], c)), ""))


def uri_scheme(uri: Column) -> Column:
    """The kind of a stored frame: ``kaggle``, ``data``, ``mp4`` or empty."""
    return F.regexp_extract(uri, "^(kaggle|data|mp4):", 1)


def uri_path(uri: Column) -> Column:
    """The path of a frame without scheme, data set and frame number."""
    return F.regexp_replace(F.regexp_replace(uri, "^(?:kaggle:[^|]*\\||data:|mp4:)", ""), "#\\d+$", "")


def uri_frame(uri: Column) -> Column:
    """The frame number of a video frame, or null."""
    found = F.regexp_extract(uri, "#(\\d+)$", 1)
    return F.when(found != "", found.cast("long"))


def build_uri(dataset: Column, path: Column) -> Column:
    return F.concat(F.lit("kaggle:"), dataset, F.lit("|"), path)
