"""Code books as small DataFrames.

Every book here is a fixed, bounded list (at most ~60 entries), so joining
against it with ``broadcast`` is safe at any data size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Petitioner codes (abbreviated book).
PETITIONER_CODES = {
    1: "attorney general of the United States",
    27: "United States",
    28: "State",
    100: "person accused, indicted, or suspected of crime",
    111: "attorney or law firm",
    113: "bank, savings and loan, credit union, investment company",
    122: "business, corporation",
    126: "person convicted of crime",
    130: "religious organization, institution, or person",
    137: "defendant",
    145: "employee or job applicant",
    151: "employer",
    170: "Indian, including Indian tribe or nation",
    171: "insurance company",
    214: "private person",
    215: "prisoner, inmate of penal institution",
    222: "racial or ethnic minority",
    249: "union, labor organization",
    327: "Department of Justice or Attorney General",
    332: "Equal Employment Opportunity Commission",
    333: "Environmental Protection Agency",
    357: "Federal Trade Commission",
    501: "Unidentifiable",
}

# State codes.
STATE_CODES = {
    1: "Alabama", 2: "Alaska", 4: "Arizona", 5: "Arkansas", 6: "California",
    7: "Colorado", 8: "Connecticut", 9: "Delaware", 10: "District of Columbia",
    12: "Florida", 13: "Georgia", 15: "Hawaii", 16: "Idaho", 17: "Illinois",
    18: "Indiana", 19: "Iowa", 20: "Kansas", 21: "Kentucky", 22: "Louisiana",
    23: "Maine", 25: "Maryland", 26: "Massachusetts", 27: "Michigan", 28: "Minnesota",
    29: "Mississippi", 30: "Missouri", 31: "Montana", 32: "Nebraska", 33: "Nevada",
    34: "New Hampshire", 35: "New Jersey", 36: "New Mexico", 37: "New York",
    38: "North Carolina", 39: "North Dakota", 41: "Ohio", 42: "Oklahoma",
    43: "Oregon", 45: "Pennsylvania", 47: "Rhode Island", 48: "South Carolina",
    49: "South Dakota", 50: "Tennessee", 51: "Texas", 52: "Utah", 53: "Vermont",
    55: "Virginia", 56: "Washington", 57: "West Virginia", 58: "Wisconsin",
    59: "Wyoming", 60: "United States",
}

# Case origin codes (abbreviated book).
CASE_ORIGIN_CODES = {
    21: "U.S. Court of Appeals, First Circuit", 22: "U.S. Court of Appeals, Second Circuit",
    23: "U.S. Court of Appeals, Third Circuit", 24: "U.S. Court of Appeals, Fourth Circuit",
    25: "U.S. Court of Appeals, Fifth Circuit", 26: "U.S. Court of Appeals, Sixth Circuit",
    27: "U.S. Court of Appeals, Seventh Circuit", 28: "U.S. Court of Appeals, Eighth Circuit",
    29: "U.S. Court of Appeals, Ninth Circuit", 30: "U.S. Court of Appeals, Tenth Circuit",
    31: "U.S. Court of Appeals, Eleventh Circuit", 32: "U.S. Court of Appeals, D.C. Circuit",
    300: "State Supreme Court", 301: "State Appellate Court", 302: "State Trial Court",
}

# Issue areas.
ISSUE_AREA_CODES = {
    1: "Criminal Procedure", 2: "Civil Rights", 3: "First Amendment", 4: "Due Process",
    5: "Privacy", 6: "Attorneys", 7: "Unions", 8: "Economic Activity",
    9: "Judicial Power", 10: "Federalism", 11: "Interstate Relations", 12: "Federal Taxation",
    13: "Miscellaneous", 14: "Private Action",
}

# State abbreviations → names.
STATE_ABBREVIATIONS = {
    "AL": "Alabama", "AK": "Alaska", "AZ": "Arizona", "AR": "Arkansas", "CA": "California",
    "CO": "Colorado", "CT": "Connecticut", "DE": "Delaware", "FL": "Florida", "GA": "Georgia",
    "HI": "Hawaii", "ID": "Idaho", "IL": "Illinois", "IN": "Indiana", "IA": "Iowa",
    "KS": "Kansas", "KY": "Kentucky", "LA": "Louisiana", "ME": "Maine", "MD": "Maryland",
    "MA": "Massachusetts", "MI": "Michigan", "MN": "Minnesota", "MS": "Mississippi",
    "MO": "Missouri", "MT": "Montana", "NE": "Nebraska", "NV": "Nevada", "NH": "New Hampshire",
    "NJ": "New Jersey", "NM": "New Mexico", "NY": "New York", "NC": "North Carolina",
    "ND": "North Dakota", "OH": "Ohio", "OK": "Oklahoma", "OR": "Oregon", "PA": "Pennsylvania",
    "RI": "Rhode Island", "SC": "South Carolina", "SD": "South Dakota", "TN": "Tennessee",
    "TX": "Texas", "UT": "Utah", "VT": "Vermont", "VA": "Virginia", "WA": "Washington",
    "WV": "West Virginia", "WI": "Wisconsin", "WY": "Wyoming", "DC": "District of Columbia",
}

# Article-title overrides for names whose page title differs.
NAME_CORRECTIONS = {
    "Howell Edmunds Jackson": "Howell_E._Jackson",
    "John Marshall Harlan II": "John_Marshall_Harlan_II",
    "John Marshall Harlan": "John_Marshall_Harlan",
    "William O. Douglas": "William_O._Douglas",
    "Byron White": "Byron_White",
}
ARTICLE_URL_PREFIX = "https://en.wikipedia.org/wiki/"

BOOKS = {
    "petitioner": PETITIONER_CODES,
    "state": STATE_CODES,
    "origin": CASE_ORIGIN_CODES,
    "issue_area": ISSUE_AREA_CODES,
}


def book_df(spark: SparkSession, book: dict, key_type: str = "int") -> DataFrame:
    """A code book as a two-column DataFrame (code, label), broadcast-marked."""
    rows = sorted(book.items())
    df = spark.createDataFrame(rows, f"code {key_type}, label string")
    return F.broadcast(df)


def book_values_sql(book: dict, key_sql_type: str = "INTEGER") -> str:
    """The same book as a DuckDB/Spark ``VALUES`` relation text (oracle side)."""
    def q(v):
        return "'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v)

    vals = ", ".join(f"({q(k)}, {q(v)})" for k, v in sorted(book.items()))
    return f"SELECT CAST(code AS {key_sql_type}) AS code, label FROM (VALUES {vals}) AS t(code, label)"
