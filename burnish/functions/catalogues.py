"""Closed vocabularies of the display profiles.  Fixed values throughout: results depend on every entry."""

from __future__ import annotations

import re
from functools import cache

# Title terms.
FREQUENCIES = {
    "semiannual": "Semi-Annual", "semiannually": "Semi-Annual", "semi-annually": "Semi-Annual",
    "biannual": "Bi-Annual", "biannually": "Bi-Annual", "bi-annually": "Bi-Annual",
    "biweekly": "Bi-Weekly", "bimonthly": "Bi-Monthly",
}
BUSINESS_TERMS = {"fhlb": "FHLB", "p&i": "P&I", "ust": "UST", "rcf": "RCF", "cmt": "CMT"}
MIXED_TERMS = {"lihtc": "LIHTC", "pud": "PUD", "sfr": "SFR", "mh": "MH"}

# Spellings of postal directionals, street suffixes and unit designators.
DIRECTIONALS = {
    "n": "N", "north": "N", "s": "S", "south": "S", "e": "E", "east": "E", "w": "W", "west": "W",
    "ne": "NE", "northeast": "NE", "nw": "NW", "northwest": "NW", "se": "SE", "southeast": "SE", "sw": "SW", "southwest": "SW",
}
SUFFIXES = {
    "alley": "Aly", "aly": "Aly", "avenue": "Ave", "av": "Ave", "ave": "Ave", "boulevard": "Blvd", "blvd": "Blvd", "center": "Ctr", "centre": "Ctr",
    "ctr": "Ctr", "circle": "Cir", "cir": "Cir", "court": "Ct", "ct": "Ct", "cove": "Cv", "cv": "Cv", "crossing": "Xing", "xing": "Xing",
    "drive": "Dr", "dr": "Dr", "expressway": "Expy", "expy": "Expy", "freeway": "Fwy", "fwy": "Fwy", "gardens": "Gdns", "gdns": "Gdns",
    "highway": "Hwy", "hwy": "Hwy", "junction": "Jct", "jct": "Jct", "lane": "Ln", "ln": "Ln", "loop": "Loop", "park": "Park", "parkway": "Pkwy",
    "pkwy": "Pkwy", "place": "Pl", "pl": "Pl", "plaza": "Plz", "plz": "Plz", "road": "Rd", "rd": "Rd", "route": "Rte", "rte": "Rte", "square": "Sq",
    "sq": "Sq", "street": "St", "str": "St", "st": "St", "terrace": "Ter", "ter": "Ter", "trail": "Trl", "trl": "Trl", "turnpike": "Tpke",
    "tpke": "Tpke", "way": "Way",
}
UNITS = {
    "apartment": "Apt", "apt": "Apt", "building": "Bldg", "bldg": "Bldg", "box": "Box", "department": "Dept", "dept": "Dept", "floor": "Fl",
    "fl": "Fl", "hangar": "Hngr", "hngr": "Hngr", "lot": "Lot", "po": "PO", "room": "Rm", "rm": "Rm", "rr": "RR", "suite": "Ste", "ste": "Ste",
    "trailer": "Trlr", "trlr": "Trlr", "unit": "Unit", "us": "US",
}
NAME_EXCEPTIONS = {"dekalb": "DeKalb", "delacruz": "DeLaCruz", "desoto": "DeSoto", "dupage": "DuPage", "lasalle": "LaSalle", "mchenry": "McHenry", "mclean": "McLean"}

# Postal codes of states and territories by code, name and conventional abbreviations, lower case and without periods.
STATES = {
    "al": "AL", "alabama": "AL", "ala": "AL", "ak": "AK", "alaska": "AK", "az": "AZ", "arizona": "AZ", "ariz": "AZ", "ar": "AR", "arkansas": "AR",
    "ark": "AR", "ca": "CA", "california": "CA", "calif": "CA", "co": "CO", "colorado": "CO", "colo": "CO", "ct": "CT", "connecticut": "CT",
    "conn": "CT", "de": "DE", "delaware": "DE", "del": "DE", "fl": "FL", "florida": "FL", "fla": "FL", "ga": "GA", "georgia": "GA", "hi": "HI",
    "hawaii": "HI", "id": "ID", "idaho": "ID", "il": "IL", "illinois": "IL", "ill": "IL", "in": "IN", "indiana": "IN", "ind": "IN", "ia": "IA",
    "iowa": "IA", "ks": "KS", "kansas": "KS", "kan": "KS", "kans": "KS", "ky": "KY", "kentucky": "KY", "la": "LA", "louisiana": "LA", "me": "ME",
    "maine": "ME", "md": "MD", "maryland": "MD", "ma": "MA", "massachusetts": "MA", "mass": "MA", "mi": "MI", "michigan": "MI", "mich": "MI",
    "mn": "MN", "minnesota": "MN", "minn": "MN", "ms": "MS", "mississippi": "MS", "miss": "MS", "mo": "MO", "missouri": "MO", "mt": "MT",
    "montana": "MT", "mont": "MT", "ne": "NE", "nebraska": "NE", "neb": "NE", "nebr": "NE", "nv": "NV", "nevada": "NV", "nev": "NV", "nh": "NH",
    "new hampshire": "NH", "nj": "NJ", "new jersey": "NJ", "nm": "NM", "new mexico": "NM", "n mex": "NM", "ny": "NY", "new york": "NY", "nc": "NC",
    "north carolina": "NC", "nd": "ND", "north dakota": "ND", "n dak": "ND", "oh": "OH", "ohio": "OH", "ok": "OK", "oklahoma": "OK", "okla": "OK",
    "or": "OR", "oregon": "OR", "ore": "OR", "oreg": "OR", "pa": "PA", "pennsylvania": "PA", "ri": "RI", "rhode island": "RI", "sc": "SC",
    "south carolina": "SC", "sd": "SD", "south dakota": "SD", "s dak": "SD", "tn": "TN", "tennessee": "TN", "tenn": "TN", "tx": "TX", "texas": "TX",
    "tex": "TX", "ut": "UT", "utah": "UT", "vt": "VT", "vermont": "VT", "va": "VA", "virginia": "VA", "wa": "WA", "washington": "WA", "wash": "WA",
    "wv": "WV", "west virginia": "WV", "w va": "WV", "wva": "WV", "wi": "WI", "wisconsin": "WI", "wis": "WI", "wisc": "WI", "wy": "WY",
    "wyoming": "WY", "wyo": "WY", "dc": "DC", "district of columbia": "DC", "washington dc": "DC", "washington d c": "DC", "as": "AS",
    "american samoa": "AS", "gu": "GU", "guam": "GU", "mp": "MP", "northern mariana islands": "MP",
    "commonwealth of the northern mariana islands": "MP", "pr": "PR", "puerto rico": "PR", "vi": "VI", "virgin islands": "VI",
    "us virgin islands": "VI", "united states virgin islands": "VI",
}

# Spellings of tenor units; a month or year may follow its number at once, the others after a space or hyphen.
MONTHS = ("months", "month", "mos", "mo", "m")
YEARS = ("years", "year", "yrs", "yr", "y")
DAYS = ("days", "day")
WEEKS = ("weeks", "week")
#: Canonical unit, spellings, what may stand between number and unit.
TENOR_UNITS = (("month", MONTHS, "[ -]?"), ("year", YEARS, "[ -]?"), ("day", DAYS, "[ -]"), ("week", WEEKS, "[ -]"))
# Spellings of interest rates and their canonical labels.
INTEREST_RATES = {
    "Prime": "Prime", "SOFR": "SOFR", "SOFR Term Overnight": "SOFR Term Overnight", "SOFR Term - Overnight": "SOFR Term Overnight",
    "SOFR Term 1-Month": "SOFR Term 1-Month", "SOFR Term - 1-Month": "SOFR Term 1-Month", "SOFR Term 3-Month": "SOFR Term 3-Month",
    "SOFR Term - 3-Month": "SOFR Term 3-Month", "SOFR Term 6-Month": "SOFR Term 6-Month", "SOFR Term - 6-Month": "SOFR Term 6-Month",
    "TSFR6M": "SOFR Term 6-Month", "SOFR Term 12-Month": "SOFR Term 12-Month", "SOFR Term - 12-Month": "SOFR Term 12-Month",
    "BSBY Overnight": "BSBY Overnight", "BSBY - Overnight": "BSBY Overnight", "BSBY 1-Month": "BSBY 1-Month", "BSBY - 1-Month": "BSBY 1-Month",
    "BSBY 3-Month": "BSBY 3-Month", "BSBY - 3-Month": "BSBY 3-Month", "BSBY 6-Month": "BSBY 6-Month", "BSBY - 6-Month": "BSBY 6-Month",
    "BSBY 12-Month": "BSBY 12-Month", "BSBY - 12-Month": "BSBY 12-Month", "Ameribor Overnight": "Ameribor Overnight",
    "Ameribor - Overnight": "Ameribor Overnight", "Ameribor 1-Week": "Ameribor 1-Week", "Ameribor - 1-Week": "Ameribor 1-Week",
    "Ameribor 1-Month": "Ameribor 1-Month", "Ameribor - 1-Month": "Ameribor 1-Month", "Ameribor 3-Month": "Ameribor 3-Month",
    "Ameribor - 3-Month": "Ameribor 3-Month", "Ameribor 6-Month": "Ameribor 6-Month", "Ameribor - 6-Month": "Ameribor 6-Month",
    "Ameribor 1-Year": "Ameribor 1-Year", "Ameribor - 1-Year": "Ameribor 1-Year", "Ameribor 2-Year": "Ameribor 2-Year",
    "Ameribor - 2-Year": "Ameribor 2-Year", "Ameribor 30-Day Average": "Ameribor 30-Day Average",
    "Ameribor - 30-Day Average": "Ameribor 30-Day Average", "Ameribor 90-Day Average": "Ameribor 90-Day Average",
    "Ameribor - 90-Day Average": "Ameribor 90-Day Average", "Ameribor Derived 30T": "Ameribor Derived 30T",
    "Ameribor - Derived 30T": "Ameribor Derived 30T", "Ameribor Derived 90T": "Ameribor Derived 90T",
    "Ameribor - Derived 90T": "Ameribor Derived 90T", "LIBOR 1-Year (Daily)": "LIBOR 1-Year (Daily)",
    "LIBOR - 1-Year (Daily)": "LIBOR 1-Year (Daily)", "Treasury 3-Month": "Treasury 3-Month", "Treasury - 3-Month": "Treasury 3-Month",
    "Treasury 6-Month": "Treasury 6-Month", "Treasury - 6-Month": "Treasury 6-Month", "Treasury 1-Year": "Treasury 1-Year",
    "Treasury - 1-Year": "Treasury 1-Year", "Treasury 2-Year": "Treasury 2-Year", "Treasury - 2-Year": "Treasury 2-Year",
    "Treasury 3-Year": "Treasury 3-Year", "Treasury - 3-Year": "Treasury 3-Year", "Treasury 5-Year": "Treasury 5-Year",
    "Treasury - 5-Year": "Treasury 5-Year", "Treasury 7-Year": "Treasury 7-Year", "Treasury - 7-Year": "Treasury 7-Year",
    "Treasury 10-Year": "Treasury 10-Year", "Treasury - 10-Year": "Treasury 10-Year", "Treasury 30-Year": "Treasury 30-Year",
    "Treasury - 30-Year": "Treasury 30-Year", "Treasury Avg 12-Month": "Treasury Avg 12-Month", "Treasury Avg - 12-Month": "Treasury Avg 12-Month",
    "Freddie Mac 1-Month": "Freddie Mac 1-Month", "Freddie Mac - 1-Month": "Freddie Mac 1-Month", "Freddie Mac 3-Month": "Freddie Mac 3-Month",
    "Freddie Mac - 3-Month": "Freddie Mac 3-Month", "Freddie Mac 6-Month": "Freddie Mac 6-Month", "Freddie Mac - 6-Month": "Freddie Mac 6-Month",
    "Freddie Mac 12-Month": "Freddie Mac 12-Month", "Freddie Mac - 12-Month": "Freddie Mac 12-Month", "FHLB 1-Year": "FHLB 1-Year",
    "FHLB - 1-Year": "FHLB 1-Year", "FHLB 2-Year": "FHLB 2-Year", "FHLB - 2-Year": "FHLB 2-Year", "FHLB 3-Year": "FHLB 3-Year",
    "FHLB - 3-Year": "FHLB 3-Year", "FHLB 5-Year": "FHLB 5-Year", "FHLB - 5-Year": "FHLB 5-Year", "FHLB 7-Year": "FHLB 7-Year",
    "FHLB - 7-Year": "FHLB 7-Year", "FHLB 10-Year": "FHLB 10-Year", "FHLB - 10-Year": "FHLB 10-Year", "SOFR 30-Day": "SOFR 30-Day",
    "SOFR - 30-Day": "SOFR 30-Day", "SOFR30": "SOFR 30-Day", "USD Swap 1-Year": "USD Swap 1-Year", "USD Swap 5-Year": "USD Swap 5-Year",
    "USD Swap 10-Year": "USD Swap 10-Year", "SOFR 1-Month": "SOFR 1-Month", "SOFR 12-Month": "SOFR 12-Month",
    "SOFR 30-Day Average": "SOFR 30-Day Average", "SOFR Avg - 30 days": "SOFR 30-Day Average", "SOFR30A": "SOFR 30-Day Average",
    "SOFR 180-Day Average": "SOFR 180-Day Average", "SOFR180A": "SOFR 180-Day Average", "RCF 6-Month": "RCF 6-Month", "RCF6M": "RCF 6-Month",
    "RCF 12-Month": "RCF 12-Month", "RCF12M": "RCF 12-Month", "1-Year Constant Maturity Treasury (CMT)": "1-Year Constant Maturity Treasury (CMT)",
    "1-Year CMT": "1-Year Constant Maturity Treasury (CMT)", "2-Year Constant Maturity Treasury (CMT)": "2-Year Constant Maturity Treasury (CMT)",
    "2-Year CMT": "2-Year Constant Maturity Treasury (CMT)", "3-Year Constant Maturity Treasury (CMT)": "3-Year Constant Maturity Treasury (CMT)",
    "3-Year CMT": "3-Year Constant Maturity Treasury (CMT)", "5-Year Constant Maturity Treasury (CMT)": "5-Year Constant Maturity Treasury (CMT)",
    "5-Year CMT": "5-Year Constant Maturity Treasury (CMT)", "7-Year Constant Maturity Treasury (CMT)": "7-Year Constant Maturity Treasury (CMT)",
    "7-Year CMT": "7-Year Constant Maturity Treasury (CMT)", "10-Year Constant Maturity Treasury (CMT)": "10-Year Constant Maturity Treasury (CMT)",
    "10-Year CMT": "10-Year Constant Maturity Treasury (CMT)",
    "30-Year Constant Maturity Treasury (CMT)": "30-Year Constant Maturity Treasury (CMT)",
    "30-Year CMT": "30-Year Constant Maturity Treasury (CMT)", "1-Month LIBOR": "1-Month LIBOR", "2-Month LIBOR": "2-Month LIBOR",
    "3-Month LIBOR": "3-Month LIBOR", "6-Month LIBOR": "6-Month LIBOR", "9-Month LIBOR": "9-Month LIBOR", "12-Month LIBOR": "12-Month LIBOR",
}


def _register(table: dict[str, str], key: str, label: str) -> None:
    if table.setdefault(key, label) != label:
        raise ValueError(f"{key!r} names both {table[key]!r} and {label!r}")


def _rate_key(text: str) -> str:
    key = re.sub(r" *- *", "-", text.lower())
    for unit, spellings, gap in TENOR_UNITS:
        key = re.sub(rf"(?<![\w.,])([1-9][0-9]*){gap}(?:{'|'.join(spellings)})(?!\w)", rf"\1-{unit}", key)
    return key


@cache
def interest_rates() -> dict[str, str]:
    """Comparison key to canonical label."""
    table: dict[str, str] = {}
    for spelling, label in INTEREST_RATES.items():
        _register(table, _rate_key(spelling), label)
    return table


DASHES = "‐‑‒–—―−"
# Spellings of property types and their canonical labels.
PROPERTY_TYPES = {
    "Single Family": "Single Family", "SFR": "Single Family", "Single Family Residential": "Single Family",
    "Single Family Attached": "Single Family", "Single-Family Attached": "Single Family", "Single Family Detached": "Single Family",
    "Single-Family Detached": "Single Family", "Single Family SemiDetached": "Single Family", "Townhouse": "Townhouse", "Townhome": "Townhouse",
    "Town House/Row House": "Townhouse", "Duplex": "Duplex", "PUD": "PUD", "Planned Unit Development": "PUD", "dPUD": "PUD", "PUD-Attached": "PUD",
    "PUD-Detached": "PUD", "Two-Unit": "Two-Unit", "2 Unit": "Two-Unit", "Two Unit": "Two-Unit", "2 Family Home": "Two-Unit",
    "Three-Unit": "Three-Unit", "3 Unit": "Three-Unit", "Three Unit": "Three-Unit", "3 Family Home": "Three-Unit", "Four-Unit": "Four-Unit",
    "4 Unit": "Four-Unit", "Four Unit": "Four-Unit", "4 Family Home": "Four-Unit", "Manufactured Housing": "Manufactured Housing",
    "MH": "Manufactured Housing", "Manufactured Home": "Manufactured Housing", "Mobile Home": "Manufactured Housing", "Coop": "Coop",
    "CO-OP": "Coop", "Condominium": "Condominium", "Condominimum": "Condominium", "Condo": "Condominium", "Condo (Stories Unknown)": "Condominium",
    "Non-Warrantable Condo": "Condominium", "NonWarrantable Condo": "Condominium", "Condo Low Rise (<= 4 Stories; Single Unit)": "Condominium",
    "Condo High Rise (> 4 Stories; single unit)": "Condominium", "Farm Land": "Farm Land", "AG RE": "Farm Land", "Ag Real Estate": "Farm Land",
    "Crops or Livestock": "Crops or Livestock", "Crops & Livestock": "Crops or Livestock", "Crops and Livestock": "Crops or Livestock",
    "Machinery & Equipment": "Machinery & Equipment", "Equipment": "Equipment", "Operating Equipment": "Operating Equipment",
    "Technology Equipment": "Technology Equipment", "Apartment - Garden": "Apartment - Garden", "Apartment - High-Rise": "Apartment - High-Rise",
    "Apartment - Low-Rise": "Apartment - Low-Rise", "Apartment": "Apartment", "Apartments": "Apartment",
    "Senior Housing - Assisted Living": "Senior Housing - Assisted Living", "Assisted Living": "Senior Housing - Assisted Living",
    "Senior Housing": "Senior Housing", "Health Care - Independent Living": "Senior Housing", "Student Housing": "Student Housing",
    "Multifamily - Student": "Student Housing", "Hotel": "Hotel", "Industrial - Warehouse": "Industrial - Warehouse",
    "Warehouse": "Industrial - Warehouse", "Industrial Warehouse": "Industrial - Warehouse", "Industrial/Warehouse": "Industrial - Warehouse",
    "Industrial Office-Warehouse": "Industrial - Warehouse", "Industrial - Manufacturing": "Industrial - Manufacturing", "Industrial": "Industrial",
    "Industrial Flex": "Industrial", "Industrial-Flex": "Industrial", "Multi-Tenant Flex": "Industrial",
    "Office - Medical Office": "Office - Medical Office", "Medical Office": "Office - Medical Office", "Office": "Office",
    "Office-Single Tenant": "Office", "Office Single Tenant": "Office", "Multi-Tenant Office": "Office", "OFFMIDRISE": "Office",
    "Retail - Regional Mall": "Retail - Regional Mall", "Retail-Regional Mall": "Retail - Regional Mall",
    "Retail Regional Mall": "Retail - Regional Mall", "Retail - Strip": "Retail - Strip", "Retail": "Retail", "Retail-Anchored": "Retail",
    "Retail Anchored": "Retail", "Retail-Unanchored": "Retail", "Retail Unanchored": "Retail", "Retail-Other": "Retail", "Retail-Mall": "Retail",
    "Grocery Store": "Retail", "Entertainment": "Entertainment", "Parking": "Parking", "Other-Parking Garage": "Parking",
    "Parking Garage": "Parking", "Restaurant": "Restaurant", "Self Storage": "Self Storage", "Other": "Other", "Oth_Comm": "Other",
    "Multifamily": "Multifamily", "Multi-Family": "Multifamily", "Multi Family": "Multifamily", "MultiFamily": "Multifamily",
    "MULTIFAMLY": "Multifamily", "Multifamily-Over 20": "Multifamily", "Multifamily Over 20": "Multifamily",
    "Multifamily - LIHTC": "Multifamily - LIHTC", "Multi Family LIHTC": "Multifamily - LIHTC", "Multifamily LIHTC": "Multifamily - LIHTC",
    "Mixed Use": "Mixed Use",
}


@cache
def property_types() -> dict[str, str]:
    """Comparison key to canonical label."""
    table: dict[str, str] = {}
    for spelling, label in PROPERTY_TYPES.items():
        _register(table, re.sub(r" *([-/&,]) *", r"\1", spelling.lower()), label)
    return table
