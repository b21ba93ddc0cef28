"""Recoding columns into classes."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Guild labels and the genus that counts as an endophyte.
KEPT_GUILDS = ("Ectomycorrhizal", "DSE", "Arbuscular Mycorrhizal")
ENDOPHYTE_GUILD = "Endophyte"
TOTAL_ENDOPHYTE = "TotalEndophyte"
OTHER_GUILD = "Other"
ENDOPHYTE_GENERA = ("Ilyonectria",)
TIME_LABELS = {"June20": "7Months", "Jan21": "12Months"}


def is_in(col: Column, values: Sequence[str]) -> Column:
    """Membership that is never NULL."""
    return F.coalesce(col.isin(*values), F.lit(False))


def guild_class(guild: Column, genus: Column, endophyte_genera: Sequence[str] = ENDOPHYTE_GENERA) -> Column:
    """Collapse primary guilds to the four reporting classes."""
    endophyte = (guild == ENDOPHYTE_GUILD) | (guild == "DSE") | genus.isin(*endophyte_genera)
    mycorrhizal = is_in(guild, [g for g in KEPT_GUILDS if g != "DSE"])
    return F.when(mycorrhizal, guild).when(endophyte, F.lit(TOTAL_ENDOPHYTE)).otherwise(F.lit(OTHER_GUILD))


def _crossed(a_on: Column, a_off: Column, b_on: Column, b_off: Column) -> Column:
    return (
        F.when(a_on & b_off, "AM").when(a_on & b_on, "DM").when(a_off & b_on, "EM").when(a_off & b_off, "NM")
    )


def presence_class(a: Column, b: Column) -> Column:
    """AM / DM / EM / NM from two percentages being positive or exactly zero."""
    return _crossed(a > 0, a == 0, b > 0, b == 0).otherwise("Invalid")


def threshold_class(a: Column, b: Column, cut: float = 0.001) -> Column:
    """The same with a cut; a value equal to the cut belongs to no class."""
    return _crossed(a > cut, a < cut, b > cut, b < cut).otherwise("Invalid")


def status_columns(am: Column, em: Column, label: Column, control: str = "Control") -> dict[str, Column]:
    """Status with controls first, plus the three flags."""
    is_control = F.coalesce(label.contains(control), F.lit(False))
    return {
        "status": F.when(is_control, "NM").otherwise(_crossed(am > 0, am == 0, em > 0, em == 0)),
        "am_flag": F.when(~is_control & (am > 0), "AMT").otherwise("AMF"),
        "em_flag": F.when(~is_control & (em > 0), "EMT").otherwise("EMF"),
        "control_flag": F.when(is_control, "Control").otherwise("NotControl"),
    }


def contrast_tag(
    first: Column, second: Column, labels: tuple[str, str], min_n: int = 5, strict_first: bool = False
) -> Column:
    """Label of the side a taxon is confined to; NULL when it is on both sides or too rare."""
    enough = first > min_n if strict_first else first >= min_n
    return F.when((first == 0) & (second >= min_n), labels[1]).when(enough & (second == 0), labels[0])


def combined_tag(time_tag: Column, species_tag: Column) -> Column:
    return (
        F.when(time_tag.isNotNull() & species_tag.isNotNull(), "TimeSpecies")
        .when(time_tag.isNotNull(), "Time")
        .when(species_tag.isNotNull(), "Species")
        .otherwise("NonSig")
    )


def recode(col: Column, mapping: Mapping[str, str] = TIME_LABELS) -> Column:
    """Replace labels; labels outside the mapping stay."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == old, new) if out is None else out.when(col == old, new)
    return col if out is None else out.otherwise(col)


def level_rank(col: Column, levels: Sequence[str]) -> Column:
    """1-based position in an explicit level order; NULL outside the levels."""
    out = F.when(col == levels[0], 1)
    for i, level in enumerate(levels[1:], start=2):
        out = out.when(col == level, i)
    return out
