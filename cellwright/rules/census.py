"""Coded values of census microdata and panels. All tables here are fixed values."""

from __future__ import annotations

# Missing-value codes: (column, low, high).
SENTINELS = [
    ("INCWAGE", 999998, 999999),
    ("INCTOT", 9999998, 9999999),
    ("INCBUSFM", 99998, 99999),
    ("INCOTHER", 99998, 99999),
    ("BIRTHYR", 9996, 9999),
]

# Birthplace groups: (number, codes). Every other code, and a missing one, is in group 4.
BIRTHPLACE_GROUPS = [
    (1, [4, 6, 41, 53]),
    (2, [1, 5, *range(8, 14), *range(16, 41), *range(42, 52), *range(54, 57), 99]),
    (3, [501]),
]
BIRTHPLACE_GROUP_LABELS = {
    1: "West Coast (AZ, CA, OR, WA)",
    2: "Rest of Continental US",
    3: "Japan",
    4: "Alaska, Hawaii, other",
}

# Occupation groups on the 1950 basis: (low, high, label).
OCCUPATION_GROUPS = [
    (0, 99, "Professional, Technical"),
    (100, 100, "Farmers (owners and tenants)"),
    (123, 123, "Farmer managers"),
    (200, 290, "administration, management"),
    (300, 490, "clerical, sales"),
    (500, 690, "craftsmen, operatives"),
    (700, 790, "Service Workers"),
    (800, 840, "Farm laborers"),
    (910, 970, "Laborers"),
]

# Age bands in 1942 by year of birth: (low, high, label).
AGE_COHORTS = [
    (1929, 1942, "0-13"),
    (1923, 1928, "14-19"),
    (1913, 1922, "20-29"),
    (1903, 1912, "30-39"),
    (1893, 1902, "40-49"),
    (1883, 1892, "50-59"),
    (None, 1882, "60+"),
]

# Country of birth by code range: (low, high, label); every other code is "Other".
BIRTH_COUNTRIES = [(1, 99, "USA"), (501, 501, "Japan")]

# Race codes: three-way class, two-way label, and the full list.
RACE_CLASSES = [(5, "japn"), (4, "chin")]
RACE_PANEL_LABELS = [(5, "Japanese"), (4, "Chinese")]
RACE_LABELS = {
    1: "White",
    2: "Black",
    3: "Native",
    4: "Chinese",
    5: "Japanese",
    6: "Asian other",
    7: "Other",
}

# 0/1 indicators of the long panel: (source column, codes that give 1, new column).
INDICATORS = [
    ("MARST", [1, 2], "married"),
    ("NATIVITY", [5], "foreign"),
    ("EDUC", [7, 8, 9, 10, 11], "edu_college"),
    ("EDUC", [6, 7, 8, 9, 10, 11], "edu_hs"),
    ("EMPSTAT", [1], "employed"),
    ("CLASSWKR", [1], "selfemp"),
    ("CLASSWKR", [2], "wagewrk"),
    ("CLASSWKRD", [29], "familywrk"),
]

# Value columns of the linked panel.
PANEL_COLUMNS = [
    "RACE", "BIRTHYR", "BPL", "INCWAGE", "INCTOT", "INCBUSFM", "INCOTHER", "STATEFIP", "COUNTYICP", "AGE", "SEX",
    "EDUCD", "CLASSWKR", "EMPSTAT", "LABFORCE", "FARM", "IND1950", "HRSWORK1", "WKSWORK1", "OCC1950", "OCCSCORE",
]

# Cell keys of the two count tables.
CELL_KEYS = ["STATEFIP", "COUNTYICP", "RACE", "SEX", "BIRTHYR", "BPL"]

# Price factor of the first panel year, in prices of the second.
PRICE_FACTOR = 1.69
