"""Codes and the words shown for them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code to wording, one table per code list. A code without wording is shown as nothing.
LIFECYCLE = {
    "NEW": "New",
    "STALE": "Not recently confirmed",
    "EXPIRED": "No longer advertised",
    "REMOVED": "Withdrawn",
}
AREA_STATUS = {
    "REGIONAL": "In a designated regional area",
    "NOT_REGIONAL": "Not in a designated regional area",
    "UNKNOWN": "Location not established",
}
AREA_FILTER = {
    "regional": "In a designated regional area",
    "elsewhere": "Not in one",
    "unplaced": "Location not established",
    "all": "Everywhere",
}
AREA_CATEGORY = {
    "CITY_OR_MAJOR_CENTRE": "designated city or major regional centre",
    "REGIONAL_CENTRE_OR_OTHER": "regional centre or other regional area",
}
AREA_BASIS = {"POSTCODE": "postcode", "REGION": "region", "STATE": "state"}
AREA_BASIS_MEANING = {
    "POSTCODE": "The postcode was looked up directly in the instrument.",
    "REGION": "The advertisement named a region rather than a place, and every postcode inside that region falls the same side of the instrument.",
    "STATE": "The instrument lists every postcode in that state or territory, so no postcode was needed.",
}
SIGNAL = {
    "OFFERED": "Sponsorship offered",
    "OPEN_TO": "Open to sponsorship",
    "MAY_BE_CONSIDERED": "Sponsorship may be considered",
    "EXCLUDED": "Sponsorship not available",
    "NOT_MENTIONED": "Not mentioned",
    "INDETERMINATE": "Description incomplete",
}
SIGNAL_MEANING = {
    "OFFERED": "This advertisement states that sponsorship is available.",
    "OPEN_TO": "This advertisement states that the employer is willing to sponsor.",
    "MAY_BE_CONSIDERED": "This advertisement raises sponsorship as a possibility rather than stating it is available, or mentions it without saying how firmly.",
    "EXCLUDED": "This advertisement states that sponsorship is not available.",
    "NOT_MENTIONED": "The whole advertisement was read and says nothing either way. It does not mean the employer never sponsors.",
    "INDETERMINATE": "Only part of this advertisement is held, so its silence proves nothing. Open the original to read it in full.",
}
SKILL_KIND = {
    "TECHNICAL": "Technical",
    "TOOL": "Tool",
    "CERTIFICATION": "Certification or licence",
    "LANGUAGE": "Language",
    "DOMAIN": "Field",
    "SOFT": "General",
}
EMPLOYMENT = {
    "FULL_TIME": "Full time",
    "PART_TIME": "Part time",
    "CASUAL": "Casual",
    "CONTRACT": "Contract",
    "TEMPORARY": "Temporary",
    "INTERNSHIP": "Internship",
    "APPRENTICESHIP": "Apprenticeship",
}

# What the reader may filter areas by, and the stored status each stands for.
AREA_FILTER_STATUS = {"regional": "REGIONAL", "elsewhere": "NOT_REGIONAL", "unplaced": "UNKNOWN"}


def label(code: Column, wording: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(part) for pair in wording.items() for part in pair])
    return F.try_element_at(table, code)


def occupation_label(code: Column, name: Column) -> Column:
    """Name and code; the code alone where the source gives no single name."""
    return (
        F.when(name.isNotNull(), F.concat(name, F.lit(" ("), code, F.lit(")")))
        .when(code == "0", "All occupations")
        .otherwise(F.concat(F.lit("Code "), code))
    )
