"""Fixed tables of the book-analysis plan.

Fixed values: they decide results and are stated as they are.
"""

from __future__ import annotations

#: Units expected in each of the 114 groups.
EXPECTED_UNITS = (
    7, 286, 200, 176, 120, 165, 206, 75, 129, 109, 123, 111, 43, 52, 99, 128, 111, 110, 98, 135,
    112, 78, 118, 64, 77, 227, 93, 88, 69, 60, 34, 30, 73, 54, 45, 83, 182, 88, 75, 85,
    54, 53, 89, 59, 37, 35, 38, 29, 18, 45, 60, 49, 62, 55, 78, 96, 29, 22, 24, 13,
    14, 11, 11, 18, 12, 12, 30, 52, 52, 44, 28, 28, 20, 56, 40, 31, 50, 40, 46, 42,
    29, 19, 36, 25, 22, 17, 19, 26, 30, 20, 15, 21, 11, 8, 8, 19, 5, 8, 8, 11,
    11, 8, 3, 9, 5, 4, 7, 3, 6, 3, 5, 4, 5, 6,
)

#: Fixed values: (group, unit, letters) that open a unit.
OPENING_LETTERS = (
    (2, 1, "الم"), (3, 1, "الم"), (7, 1, "المص"), (10, 1, "الر"), (11, 1, "الر"),
    (12, 1, "الر"), (13, 1, "المر"), (14, 1, "الر"), (15, 1, "الر"), (19, 1, "كهيعص"),
    (20, 1, "طه"), (26, 1, "طسم"), (27, 1, "طس"), (28, 1, "طسم"), (29, 1, "الم"),
    (30, 1, "الم"), (31, 1, "الم"), (32, 1, "الم"), (36, 1, "يس"), (38, 1, "ص"),
    (40, 1, "حم"), (41, 1, "حم"), (42, 1, "حم"), (42, 2, "عسق"), (43, 1, "حم"),
    (44, 1, "حم"), (45, 1, "حم"), (46, 1, "حم"), (50, 1, "ق"), (68, 1, "ن"),
)

#: Fixed values: (skeleton, rule, decomposition) of joined forms.
JOINED_FORMS = (
    ("بسم", "FUSED_BI_ISM", "بـ + اسم"),
    ("ويكأن", "FUSED_WAYKAANNA", "وي + كأن"),
    ("ويكأنه", "FUSED_WAYKAANNA", "وي + كأن + ه"),
    ("يبنؤم", "FUSED_YABNA_UMMA", "يا + ابن + أم"),
    ("أيها", "FUSED_AYYUHA", "أي + ها"),
    ("أيتها", "FUSED_AYYUHA", "أية + ها"),
    ("ألن", "FUSED_AN_LAN", "أن + لن"),
    ("كيلا", "FUSED_KAY_LA", "كي + لا"),
    ("لئلا", "FUSED_LI_AN_LA", "لـ + أن + لا"),
    ("مما", "FUSED_MIN_MA", "من + ما"),
    ("عما", "FUSED_AN_MA", "عن + ما"),
    ("ممن", "FUSED_MIN_MAN", "من + من"),
    ("عمن", "FUSED_AN_MAN", "عن + من"),
    ("أما", "FUSED_AM_MA", "أم + ما"),
    ("إما", "FUSED_IN_MA", "إن + ما"),
    ("فيم", "FUSED_FI_MA", "في + ما"),
    ("بم", "FUSED_BI_MA", "بـ + ما"),
    ("عم", "FUSED_AN_MA", "عن + ما"),
    ("مم", "FUSED_MIN_MA", "من + ما"),
    ("إنما", "FUSED_INNA_MA", "إن + ما"),
    ("أنما", "FUSED_ANNA_MA", "أن + ما"),
    ("كأنما", "FUSED_KAANNA_MA", "كأن + ما"),
    ("كلما", "FUSED_KULLA_MA", "كل + ما"),
    ("ريثما", "FUSED_RAYTHA_MA", "ريث + ما"),
    ("حيثما", "FUSED_HAYTHU_MA", "حيث + ما"),
    ("أينما", "FUSED_AYNA_MA", "أين + ما"),
    ("كيفما", "FUSED_KAYFA_MA", "كيف + ما"),
    ("نعما", "FUSED_NIMA_MA", "نعم + ما"),
    ("بئسما", "FUSED_BISA_MA", "بئس + ما"),
    ("قلما", "FUSED_QALLA_MA", "قل + ما"),
    ("لات", "FUSED_LA_TA", "لا + ت"),
    ("هذا", "FUSED_HA_DEM", "ها + ذا"),
    ("هذه", "FUSED_HA_DEM", "ها + ذه"),
    ("هذان", "FUSED_HA_DEM", "ها + ذان"),
    ("هذين", "FUSED_HA_DEM", "ها + ذين"),
    ("هؤلاء", "FUSED_HA_DEM", "ها + أولاء"),
    ("هاتين", "FUSED_HA_DEM", "ها + تين"),
    ("يومئذ", "FUSED_IDH", "يوم + إذ"),
    ("حينئذ", "FUSED_IDH", "حين + إذ"),
    ("ساعتئذ", "FUSED_IDH", "ساعة + إذ"),
    ("عندئذ", "FUSED_IDH", "عند + إذ"),
    ("يبني", "FUSED_YA_VOCATIVE", "يا + بني"),
    ("ياويلتى", "FUSED_YA_WAYLATA", "يا + ويلتى"),
    ("ويلتى", "FUSED_WAYLATA", "وي + لتى"),
)

#: Fixed values: (skeleton, vocalised surface, rule, decomposition, note); a skeleton listed here counts only in a listed surface.
SURFACE_GATE = (
    ("لم", "لِمَ", "FUSED_LI_MA", "لـ + ما", ""),
    ("إلا", "إِلَّا", "FUSED_IN_LA", "إن + لا", ""),
    ("ألا", "أَلَّا", "FUSED_AN_LA", "أن + لا", ""),
    (
        "ألا",
        "أَلَا",
        "PARTICLE_A_LA",
        "أ + لا",
        "CONTESTED: the inceptive particle أَلَا. Reading it as interrogative hamza + لا is one analysis among several; many grammarians treat it as a simple particle. Listed so the choice is yours, not the pipeline's.",
    ),
    ("أمن", "أَمَّنْ", "FUSED_AM_MAN", "أم + من", ""),
    (
        "مال",
        "مَالِ",
        "FUSED_MA_LI",
        "ما + لـ",
        "PARTIALLY AMBIGUOUS: vocalization narrows this to 3 tokens but does not fully resolve them. 18:49 and 25:7 are the fusion (ما + لـ); 24:33 (مَالِ اللَّهِ) is the noun 'wealth' in the genitive. Only context separates these — review individually.",
    ),
    ("فمال", "فَمَالِ", "FUSED_MA_LI", "فـ + ما + لـ", ""),
)

#: Words that open a header line and an opening formula, and the title that may end a header.
HEADER_WORD = "سورة"
FORMULA_WORD = "بسم"
TITLE_SUFFIX = "القرآن الكريم :"
#: Groups without an opening formula by rule, and the group whose formula is a unit.
WITHOUT_FORMULA = (9,)
FORMULA_IS_UNIT = (1,)
#: Code points the report watches.
WATCHED_CODEPOINTS = (0x0671, 0x0670, 0x06DD, 0x06DE, 0x06E9, 0x06D6, 0x0640)
#: Rule names and action texts of review rows.
TRAILING_RULE = "TRAILING_REMAINDER_AS_FINAL_AYAH"
ABSENT_RULE = "BASMALAH_ABSENT_FROM_SOURCE"
NO_ACTION = "NONE — flagged for operator review only"
TRAILING_DECOMPOSITION = "n/a — ayah boundary, not a token split"
TRAILING_NOTE = "Boundary inferred from the surah end because the source omits the closing marker. Text is verbatim; boundary is not."
TRAILING_ACTION = (
    "Source lacks the closing (n) marker for this ayah. The ayah TEXT is present verbatim; only the delimiter numeral is absent. "
    "A segmentation boundary was inferred. NO text was created."
)
ABSENT_NOTE = "Not ambiguous — simply absent from the source."
ABSENT_ACTION = (
    "NONE — Basmalah is absent from the source document for this surah and was NOT reconstructed. "
    "Definition A is 4 tokens lower than a source carrying all 113 opening Basmalahs."
)
#: What the done column of a tracker may say, and what of it means done.
DONE_ALLOWED = ("yes", "no", "true", "false", "نعم", "لا", "", "nan")
DONE_YES = ("yes", "true", "نعم")
#: Rows and tokens that the standing ledger must have.
LEDGER_ROWS, LEDGER_TOKENS = 17_576, 77_794
