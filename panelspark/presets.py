"""Word lists, lookup tables and palettes that results depend on.

They must equal the published ones for results to be comparable, so they are
written out as they are. Every function takes them as arguments; these are
only the defaults.
"""

# Rows of a sheet that never are an entity.
SKIP_NAMES = (
    "total district(s)",
    "total districts",
    "total",
    "grand total",
    "state total",
    "district total",
    "grp",
    "nan",
    "none",
    "",
)

# Pattern of aggregate rows to drop from a panel.
AGGREGATE_PATTERN = "total|grp|grand"

# File type -> (category, value column; -1 is the last column).
FILE_RULES = {
    "ipc": ("IPC Crimes", -1),
    "sll": ("SLL Crimes", -1),
    "women": ("Crimes Against Women", -1),
    "children": ("Crimes Against Children", -1),
    "scs": ("Crimes Against SCs", -1),
    "sts": ("Crimes Against STs", -1),
    "ipcjuvenile": ("Juvenile IPC", -1),
    "slljuvenile": ("Juvenile SLL", -1),
    "cyber": ("Cyber Crimes", -1),
    "missing": ("Missing Persons", 20),
}

# Words looked for in a file name, in order; the first rule whose
# words are all present gives the file type. Within one word, "|" is "or".
FILE_WORDS = (
    (("juvenile|jeveni", "ipc"), "ipcjuvenile"),
    (("juvenile|jeveni", "sll"), "slljuvenile"),
    (("ipc",), "ipc"),
    (("sll",), "sll"),
    (("women|woman",), "women"),
    (("children|child",), "children"),
    (("scs",), "scs"),
    (("sts",), "sts"),
    (("cyber",), "cyber"),
    (("missing",), "missing"),
)

# Year in a path; words that mark the header of the next section.
YEAR_PATTERN = r"(20[12]\d)"
SECTION_WORD = "state"
SECTION_MARKS = (":", "pradesh", "bengal", "uttarakhand")

# Trend classes, grades, risk levels.
TREND_NAMES = ("RISING", "FALLING", "STABLE")
CATEGORY_BAND = 10.0
ENTITY_BAND = 15.0
GRADE_CUTS = (-20, -5, 5, 20)
GRADE_LABELS = (
    "A  (Improving fast)",
    "B  (Improving)",
    "C  (Stable)",
    "D  (Worsening)",
    "F  (Critical rise)",
)
RISK_EDGES = (0, 25, 50, 75, 100)
RISK_LABELS = ("LOW", "MEDIUM", "HIGH", "CRITICAL")

# Colours.
GRADE_COLORS = {
    "A": "#27ae60",
    "B": "#2ecc71",
    "C": "#f39c12",
    "D": "#e67e22",
    "F": "#e74c3c",
}
RISK_COLORS = {
    "LOW": "#27ae60",
    "MEDIUM": "#f39c12",
    "HIGH": "#e67e22",
    "CRITICAL": "#e74c3c",
}
MAP_PALETTE = (
    "#e74c3c",
    "#3498db",
    "#2ecc71",
    "#f39c12",
    "#9b59b6",
    "#1abc9c",
    "#e67e22",
    "#27ae60",
    "#2980b9",
)

# Shape name -> panel name, and the properties that hold a name.
SHAPE_ALIASES = {
    "Allahabad": "Prayagraj",
    "Faizabad": "Ayodhya",
    "Kheri": "Khiri",
    "Lakhimpur Kheri": "Khiri",
    "Sant Ravidas Nagar": "Bhadohi",
}
SHAPE_NAME_KEYS = ("Dist_Name", "NAME_2")
SHAPE_UNKNOWN = "Unknown"

# Division -> districts.
DIVISIONS = {
    "Agra": ["Agra", "Firozabad", "Mainpuri", "Mathura"],
    "Aligarh": ["Aligarh", "Etah", "Hathras", "Kasganj"],
    "Ayodhya": ["Ambedkar Nagar", "Amethi", "Ayodhya", "Barabanki", "Sultanpur"],
    "Azamgarh": ["Azamgarh", "Ballia", "Mau"],
    "Bareilly": ["Bareilly", "Budaun", "Pilibhit", "Shahjahanpur"],
    "Basti": ["Basti", "Sant Kabir Nagar", "Siddharthnagar"],
    "Chitrakoot": ["Banda", "Chitrakoot", "Hamirpur", "Mahoba"],
    "Devipatan": ["Bahraich", "Balrampur", "Gonda", "Shravasti"],
    "Gorakhpur": ["Deoria", "Gorakhpur", "Kushinagar", "Maharajganj"],
    "Jhansi": ["Jalaun", "Jhansi", "Lalitpur"],
    "Kanpur": ["Auraiya", "Etawah", "Farrukhabad", "Kannauj", "Kanpur Dehat", "Kanpur Nagar"],
    "Lucknow": ["Hardoi", "Lucknow", "Raebareli", "Sitapur", "Unnao"],
    "Meerut": ["Baghpat", "Bulandshahr", "Ghaziabad", "Hapur", "Meerut", "Muzaffarnagar", "Shamli"],
    "Mirzapur": ["Mirzapur", "Sonbhadra"],
    "Moradabad": ["Amroha", "Bijnor", "Moradabad", "Rampur", "Sambhal"],
    "Prayagraj": ["Fatehpur", "Kaushambi", "Prayagraj", "Pratapgarh"],
    "Saharanpur": ["Saharanpur"],
    "Varanasi": ["Bhadohi", "Chandauli", "Ghazipur", "Jaunpur", "Varanasi"],
}

# Published column names of the written analyses. {first}, {last}: periods of the panel;
# {before}, {after}: the periods compared; {latest}, {next}: periods of the forecast.
OUTPUT_COLUMNS = {
    "period_trend": {
        "period": "Year",
        "total": "Total_Crimes",
        "change": "YoY_Change",
        "change_pct": "YoY_Change_pct",
    },
    "category_trend": {
        "category": "Crime_Type",
        "direction": "Direction",
        "first_total": "{first}_count",
        "last_total": "{last}_count",
        "change_pct": "Change_pct",
        "peak_period": "Peak_year",
        "peak_total": "Peak_value",
    },
    "period_category_matrix": {"period": "Year"},
    "entity_ranking": {"entity": "District", "total": "Total_All_Years", "rank": "Rank"},
    "entity_period_matrix": {"entity": "District"},
    "entity_trend": {
        "entity": "District",
        "change_pct": "Change_pct",
        "rises": "Years_rising",
        "falls": "Years_falling",
        "trend": "Trend",
    },
    "signature_categories": {
        "entity": "District",
        "rank": "Rank",
        "category": "Crime_Type",
        "total": "Total_Cases",
        "share_pct": "Pct_of_District_Total",
    },
    "intensity_scores": {
        "period": "Year",
        "entity": "District",
        "total": "Total",
        "intensity": "Intensity_Score",
    },
    "risk_levels": {
        "entity": "District",
        "avg_intensity": "Avg_Intensity_Score",
        "risk_level": "Risk_Level",
    },
    "yoy_changes": {
        "entity": "District",
        "category": "Crime_Type",
        "period": "Year",
        "total": "Total",
        "prev_total": "Prev_Year_Total",
        "change": "YoY_Change",
        "change_pct": "YoY_Pct",
    },
    "report_cards": {
        "entity": "District",
        "overall_rank": "Overall_Rank",
        "total": "Total_All_Years",
        "trend_pct": "Recent_Trend_pct",
        "grade": "Grade",
        "first_mean": "First3yr_avg",
        "last_mean": "Last3yr_avg",
    },
    "concentration": {
        "category": "Crime_Type",
        "top5_pct": "Top5_districts_pct",
        "top10_pct": "Top10_districts_pct",
        "worst_entity": "Worst_district",
        "worst_entity_pct": "Worst_district_pct",
    },
    "compare_periods": {
        "category": "Crime_Type",
        "before_total": "Pre_COVID_{before}",
        "after_total": "During_COVID_{after}",
        "change_pct": "Change_pct",
    },
    "group_rollup": {"group": "Division", "period": "Year", "total": "Total"},
    "group_totals": {"group": "Division", "total": "Total"},
    "peak_best": {
        "entity": "District",
        "peak_period": "Peak_year",
        "peak_total": "Peak_total",
        "best_period": "Best_year",
        "best_total": "Best_total",
        "peak_best_ratio": "Worst_Best_ratio",
    },
    "predictions": {
        "entity": "District",
        "category": "Crime_Type",
        "actual": "Actual_{latest}",
        "predicted": "Predicted_{next}",
        "change": "Change_cases",
        "change_pct": "Change_pct",
    },
}

# Columns of the second source; the periods compared; the regime cut-off.
SECOND_SOURCE_COLUMNS = {
    "District": "entity",
    "Year": "period",
    "Crime_Type": "category",
    "Cases_Reported": "total",
}
SECOND_SOURCE_SECTION_COLUMN = "State"
COMPARED_PERIODS = (2019, 2020)
REGIME_CUTOFF = 2016
