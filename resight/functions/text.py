"""Names, paths, dates and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Viewpoints that mean the view is from the right.
RIGHT_VIEWS = ("right", "r", "dorsal fin right", "dorsal_fin_right")
# Fixed value: the placeholder of an unknown individual.
UNKNOWN = "____"
# Fixed value: text date format of the sighting catalogue.
CATALOGUE_DATE = "MM/dd/yy HH:mm:ss"


def flip_flag(viewpoint: Column) -> Column:
    """Is the view mirrored before matching? Null means no."""
    return F.coalesce(F.lower(viewpoint).isin(*RIGHT_VIEWS), F.lit(False))


def contains_right(viewpoint: Column) -> Column:
    """The test training data uses: case-sensitive substring."""
    return F.coalesce(viewpoint.contains("right"), F.lit(False))


def file_stem(path: Column) -> Column:
    """Last path part without its extension; a leading dot is no extension."""
    base = F.regexp_extract(path, r"([^/]*)$", 1)
    return F.regexp_extract(base, r"^(\.*[^.]*(?:\.[^.]+)*?)(?:\.[^.]*)?$", 1)


def compound_id(*parts: Column) -> Column:
    return F.concat_ws("-", *[p.cast("string") for p in parts])


def scale_key(scale: Column) -> Column:
    return F.format_string("%.3f", scale.cast("double"))


def finished_encounter(folder: Column) -> Column:
    return F.lower(folder).endswith("done") & ~folder.startswith(".")


def catalogue_timestamp(text: Column) -> Column:
    return F.to_timestamp_ntz(text, F.lit(CATALOGUE_DATE))


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a wall-clock time, whatever the session zone."""
    days = F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("bigint")
    seconds = F.hour(ts).cast("bigint") * 3600 + F.minute(ts).cast("bigint") * 60
    micros = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return days * 86_400_000_000 + seconds * 1_000_000 + micros


def hours_between(later: Column, earlier: Column) -> Column:
    return (epoch_micros(later) - epoch_micros(earlier)) / F.lit(3_600_000_000.0)


def is_unknown(name: Column, placeholder: str = UNKNOWN) -> Column:
    return name == F.lit(placeholder)


def own_name_if_unknown(name: Column, row_id: Column, placeholder: str = UNKNOWN) -> Column:
    """Give each unknown its own name, derived from the row id so reruns agree."""
    return F.when(is_unknown(name, placeholder), F.concat(F.lit("unknown-"), row_id.cast("string"))).otherwise(name)


def fingerprint(*cols: Column) -> Column:
    return F.sha2(F.concat_ws("|", *[c.cast("string") for c in cols]), 256)


def shuffle_key(seed, *cols: Column) -> Column:
    """Reproducible stand-in for a random order."""
    seed_col = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", seed_col.cast("string"), *[c.cast("string") for c in cols]))
