"""Layout and coded values of the register cards. All tables here are fixed values.

Codes follow the codebook of the cards; '-' and '&' are punches of their own, so codes are text.
"""

from __future__ import annotations

# Field widths of one 80-character card, in order.
CARD_WIDTHS = [
    ("last_name", 10),
    ("first_name", 8),
    ("initial", 1),
    ("camp", 1),
    ("assembly", 1),
    ("prev_address", 5),
    ("brth_cntry_pnts", 1),
    ("fath_occ_us", 1),
    ("fath_occ_abroad", 1),
    ("school_jap", 1),
    ("school_jap2", 1),
    ("high_educ", 1),
    ("arrival_us", 2),
    ("length_jap", 1),
    ("times_jap", 1),
    ("age_jap", 1),
    ("military", 1),
    ("ind_number", 6),
    ("sex_marrge", 1),
    ("race_raw", 1),
    ("birth_yr", 2),
    ("birthplace", 2),
    ("japsch_ssn", 1),
    ("educ", 1),
    ("lang", 1),
    ("rel", 1),
    ("qual_occ_1", 3),
    ("qual_occ_2", 3),
    ("qual_occ_3", 3),
    ("pot_occ_1", 3),
    ("pot_occ_2", 3),
    ("file_no", 6),
    ("file_no_2", 5),
]

CAMPS = {
    "0": "Jerome",
    "1": "Manzanar",
    "2": "Poston",
    "3": "Gila River",
    "4": "Tule Lake",
    "5": "Minidoka",
    "6": "Topaz",
    "7": "Heart Mountain",
    "8": "Granada",
    "9": "Rohwer",
    "D": "miscoded",
    "I": "miscoded",
    "R": "miscoded",
}

ASSEMBLY_CENTERS = {
    "-": "Sacramento",
    "0": "none",
    "1": "Manzanar",
    "2": "Fresno",
    "3": "Marysville",
    "4": "Mayor",
    "5": "Merced",
    "6": "Pinedale",
    "7": "Pomona",
    "8": "Portland",
    "9": "Puyallup",
    "A": "Salinas",
    "B": "Santa Anita",
    "C": "Stockton",
    "D": "Tanforan",
    "E": "Tulare",
    "F": "Turlock",
    "Z": "miscode",
}

# One code holds sex and marital status: code -> sex (1 male, 2 female), code -> marital status
# (1 single, 2 married, 3 widowed, 4 divorced, 5 separated).
SEX_OF_CODE = {"0": 1, "1": 1, "2": 1, "3": 1, "4": 1, "5": 1, "6": 2, "7": 2, "8": 2, "9": 2, "-": 2, "&": 2}
MARITAL_OF_CODE = {"1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 1, "7": 2, "8": 3, "9": 4, "-": 5}

# Race from the race code; foreign birthplace comes next; the last two codes are "other" (0).
RACE_JAPANESE = ["4", "7", "L", "O", "V", "5", "J", "M", "P", "W", "6", "K", "N", "Q", "X"]
RACE_WHITE = ["8", "S", "T", "U"]
RACE_OTHER = ["1", "2"]
FOREIGN_BIRTHPLACES = [
    "81", "82", "83", "84", "80", "8-", "8&", "9-", "90", "92", "93", "94", "95", "96", "97", "98", "99",
]

# One code holds the birthplaces of both parents: 501 Japan, 99 mainland states, 15 Hawaii.
FATHER_BIRTHPLACE = [
    (501, ["B", "1", "4", "7", "C"]),
    (99, ["K", "2", "5", "8", "L"]),
    (15, ["T", "3", "6", "9", "U"]),
]
MOTHER_BIRTHPLACE = [
    (501, ["A", "1", "2", "3", "D"]),
    (99, ["J", "4", "5", "6", "M"]),
    (15, ["S", "7", "8", "9", "V"]),
]
NATIVE_PARENT = [15, 99]
FOREIGN_PARENT = 501

# Years of schooling abroad; '&' is unknown.
SCHOOL_YEARS = {
    "0": 0, "1": 1, "2": 2, "3": 3, "4": 4, "5": 5, "6": 6, "7": 7, "8": 8, "9": 9,
    "A": 10, "B": 11, "C": 12, "D": 13, "E": 14, "F": 15, "G": 16,
}

# Degree code -> field, and -> highest degree.
DEGREE_FIELD = [
    (0, ["A", "J", "1"]),
    (11, ["B", "K"]),
    (60, ["C", "L"]),
    (36, ["D", "M"]),
    (24, ["E", "N"]),
    (29, ["F", "O"]),
    (50, ["G", "P"]),
    (54, ["H", "Q"]),
    (37, ["I", "R"]),
    (2, ["2"]),
    (3, ["3"]),
]
HIGHEST_DEGREE = [
    ("bachelors", ["A", "B", "C", "D", "E", "F", "G", "H", "I"]),
    ("masters", ["J", "K", "L", "M", "N", "O", "P", "Q", "R"]),
    ("doctorate", ["1", "2"]),
    ("certificate", ["3"]),
]

# Grade code -> years of schooling; the first row that names a code wins.
SCHOOL_GRADE = [
    (0, ["J"]),
    (1, ["S", "K"]),
    (2, ["T", "L"]),
    (3, ["U", "M"]),
    (4, ["V", "N"]),
    (5, ["W", "O"]),
    (6, ["X", "P"]),
    (7, ["Y", "Q"]),
    (8, ["Z", "F"]),
    (9, ["A", "G"]),
    (10, ["B", "H"]),
    (11, ["C", "I"]),
    (12, ["D", "I", "E"]),
    (14, ["1", "5"]),
    (15, ["2", "6"]),
    (16, ["3", "7"]),
    (17, ["4", "8"]),
    (18, ["_", "9"]),
]

# Birthplace: (code, name, standard numeric code or None).
BIRTHPLACES = [
    ("00", "United States Unspecified", 99),
    ("11", "Washington", 53),
    ("12", "Oregon", 41),
    ("13", "California", 6),
    ("21", "New Mexico", 35),
    ("22", "Colorado", 8),
    ("23", "Idaho", 16),
    ("24", "Montana", 30),
    ("25", "Nevada", 32),
    ("26", "Arizona", 4),
    ("27", "Utah", 49),
    ("28", "Wyoming", 56),
    ("31", "Alabama", 1),
    ("32", "Arkansas", 5),
    ("33", "Kentucky", 21),
    ("34", "Louisiana", 22),
    ("35", "Mississippi", 28),
    ("36", "Oklahoma", 40),
    ("37", "Tennessee", 47),
    ("38", "Texas", 48),
    ("4&", "Wisconsin", 55),
    ("4-", "South Dakota", 46),
    ("40", "Ohio", 39),
    ("41", "Illinois", 17),
    ("42", "Indiana", 18),
    ("43", "Iowa", 19),
    ("44", "Kansas", 20),
    ("45", "Michigan", 26),
    ("46", "Minnesota", 27),
    ("47", "Missouri", 29),
    ("48", "Nebraska", 31),
    ("49", "North Dakota", 38),
    ("5&", "West Virginia", 54),
    ("5-", "Virginia", 51),
    ("50", "South Carolina", 45),
    ("51", "District of Columbia", 11),
    ("52", "Delaware", 10),
    ("53", "Florida", 12),
    ("54", "Georgia", 13),
    ("55", "Maryland", 24),
    ("56", "New Jersey", 34),
    ("57", "New York", 36),
    ("58", "North Carolina", 37),
    ("59", "Pennsylvania", 42),
    ("61", "Connecticut", 9),
    ("62", "Maine", 23),
    ("63", "Massachusetts", 25),
    ("64", "New Hampshire", 33),
    ("65", "Rhode Island", 44),
    ("66", "Vermont", 50),
    ("70", "Hawaii, Unspecified", 15),
    ("71", "Hawaii County", 15),
    ("72", "Honolulu County", 15),
    ("73", "Kauai County", 15),
    ("74", "Maui County", 15),
    ("81", "Alaska", 2),
    ("82", "Canada", 150),
    ("83", "Mexico", 200),
    ("84", "South America", 300),
    ("85", "American Samoa", None),
    ("86", "Guam", None),
    ("87", "Puerto Rico", None),
    ("88", "Virgin Islands", None),
    ("89", "Wake Island", None),
    ("80", "Poland", None),
    ("8-", "Germany", None),
    ("8&", "Ireland", None),
    ("90", "Japan, Unspecified", 501),
    ("91", "Sakhalin or Saghalien or Karafuto Is", 501),
    ("92", "Hokkaido or Yezu Is.", 501),
    ("93", "Honshu Northern Division", 501),
    ("94", "Honshu Central Division", 501),
    ("95", "Honshu Central Division", 501),
    ("96", "Honshu Southern Division", 501),
    ("97", "Urban Prefectures (Kyoto, Osaka, and Tokyo)", 501),
    ("98", "Shikoku", 501),
    ("99", "Kyushu", 501),
    ("9-", "Formosa/Taiwan", None),
    ("9&", "Chosen/Korea", None),
    ("--", "Other", None),
]

# Country of birth: the states with their islands and Alaska, Japan with Formosa, and the other countries by their own name.
# Territories (85 to 89) and Korea have none.
_ABROAD = ["80", "8-", "8&", "82", "83", "84", "--"]
BIRTH_COUNTRY = [
    ("United States", [code for code, _, number in BIRTHPLACES if number is not None and number < 100]),
    ("Japan", [code for code, _, number in BIRTHPLACES if number == 501] + ["9-"]),
    *[(name, [code]) for code, name, _ in BIRTHPLACES if code in _ABROAD],
]

# Columns of the cleaned register, in order.
REGISTER_COLUMNS = [
    "ind_number", "state", "county", "city", "camp", "assembly", "RACE", "SEX", "BIRTHYR", "BPL", "birthplace",
    "bpl_pop", "bpl_mom", "YRIMMIG", "NATIVITY", "generation", "DEGFIELD", "high_deg", "EDUC", "bpl_grp", "byr_grp",
    "fath_occ_us", "fath_occ_abroad", "school_jap", "NHGISST", "NHGISCTY", "STATEFIP", "COUNTYICP", "last_name",
    "first_name", "qual_occ_1", "qual_occ_2",
]
ADDRESS_SCHEMA = (
    "prev_address string, state string, county string, city string, NHGISST string, NHGISCTY string, "
    "ICPSRFIP double, STATEFIP int, COUNTYICP int"
)
