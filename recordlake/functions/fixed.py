"""Values that results depend on, stated plainly."""

# Thresholds of the matter-count bands.
THRESHOLDS = (10000, 5000, 1000, 500, 250, 100, 50, 25, 10, 5, 2, 1)

# Company suffixes dropped from comparable names.
NAME_SUFFIXES = ("COMPANY", "COMPANIES", "CO", "CORP", "CORPORATION", "INCORPORATED", "INC", "LLC", "LLP", "LP", "LTD", "LIMITED", "NA")

# Order of record groups; categories by a prefix's first letter.
GROUP_ORDER = ("Civil", "Family", "Probate", "Appeals", "Criminal", "Legacy", "Other")
CATEGORY_BY_INITIAL = {"C": "Civil", "F": "Family", "P": "Probate", "A": "Appeals"}
COURT_GROUPS = {"A": "Appeals", "C": "Civil", "F": "Family", "P": "Probate"}

# Prefixes from which a matter's type is inferred.
MATTER_PREFIXES = {
    "Civil": ("CGC", "CJC", "CSM", "CUD", "CPF", "PCN"),
    "Probate": ("PES", "PTR"),
    "Family": ("DPO", "FAD", "FCS", "FDI", "FDV", "FJD", "FLD", "FMS", "FPT", "FSD"),
    "Criminal": ("CRI",),
}

# Names of the two letters behind a court letter.
PREFIX_TYPE_NAMES = {
    "AC": "CARE Act Cases",
    "AD": "Adoption",
    "AO": "Mental Health - Assisted Outpatient Treatment",
    "CH": "Harassment",
    "CN": "Conservatorship",
    "CS": "Child Support",
    "DI": "Dissolution",
    "DV": "Domestic Violence",
    "DW": "Deposited Wills",
    "DX": "Deposited Wills",
    "ED": "Elder and Dependent Abuse",
    "ES": "Estate",
    "GC": "General Civil",
    "GN": "Guardianship",
    "HO": "Mental Health - Hold",
    "JC": "Judicial Council Coordinated Cases",
    "JD": "Juvenile Dependency",
    "JW": "Juvenile Criminal",
    "LD": "Juvenile Custody",
    "LM": "Civil Limited",
    "MH": "Mental Health",
    "MS": "Miscellaneous",
    "NC": "Name Change",
    "PF": "Petition",
    "PP": "Criminal/Traffic",
    "PT": "Parentage",
    "SD": "Summary Dissolution",
    "SM": "Small Claims",
    "TR": "Trust",
    "UD": "Unlawful Detainer",
    "WH": "Writ of Habeas Corpus",
}

# Known prefixes with group, name and the year they were retired.
PREFIX_NAMES = {
    "AJD": ("Appeals", "Juvenile Dependency", None),
    "AJW": ("Appeals", "Juvenile Criminal", None),
    "ALM": ("Appeals", "Civil Limited", 2002),
    "APP": ("Appeals", "Appeals", None),
    "CAC": ("Civil", "CARE Act Cases", None),
    "CCH": ("Civil", "Harassment", None),
    "CGC": ("Civil", "General Civil", None),
    "CJC": ("Civil", "Judicial Council Coordinated Cases", None),
    "CNC": ("Civil", "Name Change", None),
    "CPF": ("Civil", "Petition", None),
    "CMS": ("Civil", "Miscellaneous", 1987),
    "CSM": ("Civil", "Small Claims", None),
    "CUD": ("Civil", "Unlawful Detainer", None),
    "DPO": ("Family", "Declaration of Domestic Partnership", 2001),
    "FAD": ("Family", "Adoption", None),
    "FCS": ("Family", "Child Support", None),
    "FDI": ("Family", "Dissolution", None),
    "FDV": ("Family", "Domestic Violence", None),
    "FJD": ("Family", "Juvenile Dependency Mediation", None),
    "FLD": ("Family", "Juvenile Custody", None),
    "FMS": ("Family", "Miscellaneous", None),
    "FPT": ("Family", "Parentage", None),
    "FSD": ("Family", "Summary Dissolution", None),
    "PAO": ("Probate", "Mental Health - Assisted Outpatient Treatment", None),
    "PCN": ("Probate", "Conservatorship", None),
    "PDW": ("Probate", "Deposited Wills", None),
    "PDX": ("Probate", "Deposited Wills", None),
    "PED": ("Probate", "Elder and Dependent Abuse", 2013),
    "PES": ("Probate", "Estate", None),
    "PGN": ("Probate", "Guardianship", None),
    "PHO": ("Probate", "Mental Health - Hold", None),
    "PMH": ("Probate", "Mental Health", None),
    "PPF": ("Probate", "Petition", 1999),
    "PTR": ("Probate", "Trust", None),
    "PWH": ("Probate", "Writ of Habeas Corpus", None),
    "CRI": ("Criminal", "Criminal", None),
}

# Rules that place government offices, first match wins.
GOVERNMENT_RULES = (
    ("Joint Powers Authorities", r"JOINT POWERS|(?:^| )JPA(?: |$)"),
    ("Federal", r"UNITED STATES|(?:^| )(?:FEDERAL|U\.S\.|US)(?: |$)"),
    (
        "City and County of San Francisco",
        r"CITY AND COUNTY OF SAN FRANCISCO|CCSF|^(?=.*(?:SAN FRANCISCO|(?:^| )SF(?: |$)))"
        r"(?=.*(?:CITY ATTORNEY|DISTRICT ATTORNEY|DIST ATTY|PUBLIC DEFENDER|COUNTY COUNSEL|FAMILY SUPPORT|DEPT OF CHILD SUPPORT|DEPARTMENT OF CHILD SUPPORT))",
    ),
    ("State", r"STATE OF CALIFORNIA|ATTORNEY GENERAL|LABOR COMMISSIONER"),
    (
        "Municipalities",
        r"\b(?:CITY|COUNTY|MUNICIPAL|DISTRICT\s+ATTORNEY|DIST\s+ATTY|PUBLIC\s+DEFENDER|COUNTY\s+COUNSEL|CITY\s+ATTORNEY|FAMILY\s+SUPPORT"
        r"|DEPT\.?\s+OF\s+CHILD\s+SUPPORT|DEPARTMENT\s+OF\s+CHILD\s+SUPPORT|POLICE\s+DEPARTMENT|SHERIFF|PROBATION)\b",
    ),
)

# Words that mark a private firm.
PRIVATE_FIRM = (
    r"(?i)\b(?:LAW\s+OFFICES?|LAW\s+GROUP|LEGAL\s+GROUP|ATTORNEYS?\s+AT\s+LAW|LLP|L\.L\.P\.|LLC|L\.L\.C\.|APC|A\.P\.C\.|PC|P\.C\."
    r"|INC\.?|CORP\.?|ASSOCIATES|PARTNERS|FIRM|COUNSEL)\b"
)

# Roles that stand in parentheses behind a party's name.
PARTY_ROLES = (
    "PLAINTIFF", "DEFENDANT", "PETITIONER", "RESPONDENT", "CLAIMANT", "CREDITOR", "DEBTOR", "INTERVENOR", "CONSERVATOR",
    "CONSERVATEE", "TRUSTEE", "TRUSTOR", "BENEFICIARY", "GUARDIAN", "MINOR", "DECEDENT", "HEIR", "WARD", "OTHER", "APPELLANT",
    "APPELLEE", "OBJECTOR", "REQUESTOR", "REQUESTER", "ASSIGNEE", "ASSIGNOR", "RECEIVER", "DEPONENT", "GARNISHEE",
    r"LIEN\s*CLAIMANT", "MOVANT", "PETITONER", r"CROSS[\s-]?(?:DEFENDANT|COMPLAINANT|PLAINTIFF|RESPONDENT|APPELLANT|PETITIONER)",
    r"PERSON\s+TO\s+BE\s+PROTECTED", r"PROTECTED\s+PERSON", r"PERSONAL\s+REPRESENTATIVE", r"REAL\s+PARTY(?:\s+IN\s+INTEREST)?",
    r"PARTY\s+IN\s+INTEREST", r"THIRD\s+PARTY", r"NON[\s-]?PARTY", "ADMINISTRATOR", "EXECUTOR", "EXECUTRIX", "PROPONENT",
    "CONTESTANT", "SUBROGEE",
)

# Words kept in capitals and words kept small in labels.
ACRONYMS = (
    "UCL", "FAL", "CLRA", "IIED", "NIED", "PAGA", "FEHA", "ADA", "FMLA", "CFRA", "WARN", "RICO", "TILA", "FDCPA", "FCRA", "IWC",
    "LLC", "INC", "LLP", "PC", "USA", "US", "CA", "DBA", "DFEH", "EDD", "IRS", "DOE", "I", "II", "III", "IV", "V", "VI", "VII",
    "VIII", "IX", "X",
)
CONNECTORS = (
    "of", "the", "and", "or", "a", "an", "to", "in", "for", "on", "with", "by", "at", "as", "et", "seq", "per", "under", "from",
    "into",
)

# Offices that name no person.
ANONYMOUS_OFFICER = (
    r"(?i)^(?:nan|null|none|settlement\s+attorney(?:\s*\d+(?:\s*/\s*\d+)*)?|visiting\s+judge|unknown\s+judge"
    r"|(?:judge\s+)?pro\s*[- ]?\s*tem(?:pore)?(?:\s+judge)?|tba|tbd|to\s+be\s+(?:assigned|determined)|commissioner|hearing\s+officer"
    r"|temporary\s+judge|dept\.?\s*\d+|department\s*\d+|courtroom\s+closed|referee)$"
)

# Code systems with the aliases that stand for them.
CODE_ALIASES = {
    "PC": ("PC", "PEN CODE", "PENAL CODE"),
    "HS": ("HS", "H&S", "H & S", "HEALTH AND SAFETY CODE"),
    "VC": ("VC", "VEH CODE", "VEHICLE CODE"),
    "BP": ("BP", "B&P", "B & P", "BUS AND PROF CODE", "BUSINESS AND PROF CODE", "BUSINESS AND PROFESSIONS CODE"),
    "CC": ("CC", "CI", "CIV CODE", "CIVIL CODE"),
    "GC": ("GC", "GOV CODE", "GOVERNMENT CODE"),
    "FG": ("FG", "FGC", "F&G", "F & G", "FISH AND GAME CODE"),
    "HN": ("HN", "HNC", "H&N", "H & N", "HARBOR AND NAV CODE", "HARBORS AND NAV CODE", "HARBORS AND NAVIGATION CODE"),
    "PR": ("PR", "PRC", "PUBLIC RES CODE", "PUBLIC RESOURCES CODE"),
    "WI": ("WI", "WIC", "W&I", "W & I", "WELFARE AND INSTITUTIONS CODE"),
    "FA": ("FA", "FAC", "FOOD AND AG CODE", "FOOD AND AGRICULTURAL CODE"),
    "ED": ("ED", "EC", "EDC", "EDUCATION CODE"),
    "EL": ("EL", "ELECTION CODE", "ELECTIONS CODE"),
    "IC": ("IC", "INS CODE", "INSURANCE CODE"),
    "LC": ("LC", "LAB CODE", "LABOR CODE"),
    "RT": ("RT", "RTC", "REV AND TAX CODE", "REVENUE AND TAX CODE", "REVENUE AND TAXATION CODE"),
    "UI": ("UI", "UIC", "UNEMPLOYMENT INS CODE", "UNEMPLOYMENT INSURANCE CODE"),
    "FC": ("FC", "FIN CODE", "FINANCIAL CODE"),
    "PU": ("PU", "PUC", "PUBLIC UTIL CODE", "PUBLIC UTILITIES CODE"),
    "WC": ("WC", "WAT CODE", "WATER CODE"),
    "SH": ("SH", "SHC", "STREETS AND HIGHWAYS CODE", "STREET AND HIGHWAY CODE"),
    "CCP": ("CCP", "CP", "CODE OF CIVIL PROCEDURE"),
}

# Spellings that a citation may have beside the aliases; they keep their own name.
CODE_SPELLINGS = (
    "PEN", "HSC", "VEH", "BPC", "CIV", "GOV", "BUS AND PROFESSIONS CODE", "HARBOR AND NAVIGATION CODE", "REV AND TAXATION CODE",
    "STREETS AND HIGHWAY CODE", "STREET AND HIGHWAYS CODE",
)
SECTION_NUMBER = r"\d+[A-Za-z]?(?:\.\d+)?(?:\([A-Za-z0-9,]+\))*"
CHARGE_SENTINEL = r"\b(?:8{5,}|9{5,}|0{5,})\b"

# Names of the code systems, and the law codes of the official text.
CODE_NAMES = {
    "PC": "Penal Code",
    "HS": "Health and Safety Code",
    "VC": "Vehicle Code",
    "BP": "Business and Professions Code",
    "CC": "Civil Code",
    "GC": "Government Code",
    "FG": "Fish and Game Code",
    "HN": "Harbors and Navigation Code",
    "PR": "Public Resources Code",
    "WI": "Welfare and Institutions Code",
    "FA": "Food and Agricultural Code",
    "ED": "Education Code",
    "EL": "Elections Code",
    "IC": "Insurance Code",
    "LC": "Labor Code",
    "RT": "Revenue and Taxation Code",
    "UI": "Unemployment Insurance Code",
    "FC": "Financial Code",
    "PU": "Public Utilities Code",
    "WC": "Water Code",
    "SH": "Streets and Highways Code",
    "CCP": "Code of Civil Procedure",
}
LAW_CODES = {
    "PC": "PEN", "HS": "HSC", "VC": "VEH", "BP": "BPC", "CC": "CIV", "GC": "GOV", "FG": "FGC", "HN": "HNC", "PR": "PRC", "WI": "WIC",
    "FA": "FAC", "ED": "EDC", "EL": "ELEC", "IC": "INS", "LC": "LAB", "RT": "RTC", "UI": "UIC", "FC": "FIN", "PU": "PUC", "WC": "WAT",
    "SH": "SHC", "CCP": "CCP",
}
LAW_TEXT = "https://leginfo.legislature.ca.gov/faces/codes_displaySection.xhtml"

# Statutes cited in criminal dockets, those of procedure, and words that make a line a charge.
DOCKET_STATUTE = r"(?i)\b(?:PC|PEN(?:AL)?\s+CODE|HS|VC|BP|CC|GC)\s*(?:§|SECTION|SEC\.)?\s*\d+[A-Za-z]?(?:\.\d+)?(?:\([^)]+\))*"
PROCEDURAL_STATUTE = r"(?i)\b(?:PC\s*(?:1001\.3[56]|1001\.95|1538\.5|1050|1203\.2|1369|1370|1382|1385|1417|3000\.08|3455|4011(?:\.6)?))\b"
CHARGE_WORDS = r"(?i)\b(?:complaint|information|indictment|charge|plea)\b"

# Titles that say nothing, and how captions split.
GENERIC_TITLE = r"(?i)^\s*(?:san\s+francisco\s+(?:superior\s+court\s+)?(?:civil|criminal)?\s*case|civil\s+case|criminal\s+case)\b"
GENERIC_CRIMINAL_TITLE = (
    r"(?i)^(?:San Francisco criminal case(?:\s+\d+)?|San Francisco Superior Court case(?:\s+(?:CRI[-_\s]*)?\d+)?)$"
    r"|\b(?:Name Search by Attorney Name|Enter the complete|Criminal Case Search|Search by|Defendant Name|Attorney Name)\b"
)
UNRESOLVED_TITLE = r"(?i)^Criminal identity (?:unavailable|unresolved):"
CAPTION_SPLIT = r"(?i)\s+(?:vs\.?|v\.?|versus)\s+"
SUBJECT_TITLE = r"(?i)^\s*(?:in\s+re|in\s+the\s+matter\s+of|estate\s+of|conservatorship\s+of|guardianship\s+of)\s*:?\s+(.+)$"
PEOPLE = r"(?i)^\s*(?:the\s+)?people\s+of\s+the\s+state\s+of\s+california\s*$"

# Words of a notice that a case is not public, and the machine reason that is never shown.
NOT_PUBLIC = r"(?i)\b(?:not\s+public(?:ly)?\s+available|confidential|sealed|restricted|not\s+available\s+to\s+the\s+public)\b"
MACHINE_REASON = r"(?i)\bcriminal_portal_no_public_entries\b"

# Notices of restricted cases as (pattern, title, subtitle), first match wins.
NO_DETAIL = "No additional public docket detail is available in the captured record."
NOTICES = (
    (r"(?i)ccp\s*1161\.2\.5", "Case is not available for viewing per Civ. Proc. Code § 1161.2.5", ""),
    (r"(?i)ccp\s*1161\.2", "Case is not available for viewing per Civ. Proc. Code § 1161.2", ""),
    (r"2\.503", "Case is restricted from the Court's website pursuant to Rule of Court subdivisions 2.503(A)(1) and 2.503(C).", ""),
    (r"(?i)restricted\s+pursuant\s+to\s+court\s+order", "Case is restricted pursuant to an order of the Court.", NO_DETAIL),
    (r"482\.050", "Public access to this case is restricted pursuant to Civ. Proc. Code 482.050", ""),
    (r"12652", "Public access to this case is restricted pursuant to Government Code § 12652 subd. (c)", ""),
    (r"(?i)not\s+available\s+for\s+viewing", "Case not available for viewing", NO_DETAIL),
    (r"^$", "Case not available for viewing", NO_DETAIL),
)
NOTICE_RULES = ("CCP 1161.2.5", "CCP 1161.2", "CRC 2.503", "court order", "CCP 482.050", "GOV 12652", "none", "none")

# Labels that are no cause of action.
JUNK_CAUSE = r"(?i)^(and|et al\.?|inclusive|et seq\.?|page \d+ of \d+|demand for jury trial|jury trial demanded|parties|introduction|summary|facts|exhibit\b.*|attachment\b.*)$"
NOT_A_CAUSE = (
    r"(?i)^(?:residency verified|verified|verification|civil case cover sheet|case management\b.*|proof of service\b.*|summons(?: and complaint)?(?:\b.*)?"
    r"|notice(?:\b.*)?|other non[- ]exempt complaints?|exempt collections\b.*|complaint(?: for damages)?|damages|money|will deposited\b.*|custody order\b.*"
    r"|domestic violence prevention\b.*|statement of registration\b.*|register of out of state\b.*|sister state judgment\b.*|summary judgment\b.*"
    r"|labor judgment\b.*|criminal appeal\b.*|small claims appeal\b.*|notice to creditors\b.*)$"
)
PLEADING_PROSE = r"(?i)\b(?:at all times|is informed and believes|venue is proper|jurisdiction is proper|realleges|reallege|incorporates?|incorporate by reference)\b"
PARTY_START = (
    r"(?i)^(?:plaintiff|plaintiffs|defendant|defendants|cross-complainant|cross-complainants|cross-defendant|cross-defendants|petitioner|petitioners"
    r"|respondent|respondents)\b"
)
PARTY_VERB = (
    r"(?i)\b(?:is|are|was|were|has|have|alleges?|contends?|claims?|owns?|operates?|resides?|seeks?|brings?|files?|entered|failed|refused)\b"
)
NUMBERED_PARTY = r"(?i)^\d+\s+(?:plaintiff|defendant|petitioner|respondent)\b"

# Citations inside a cause's label, and what follows the heading of a cause.
CITES_STATUTE = r"(?i)§|\bcode\b|\bsection\b|\bstat\b|\bu\.?s\.?c\.?\b|\bb\.?p\.?c\.?\b|et seq"
INLINE_CITATION = r"(?i)\b(?:in violation of\s+)?((?:cal\.?\s+)?[a-z.&'’ ]*?\bcode\b[^;]*?(?:§+\s*[^;]+)?(?:et seq\.?)?)\s*;?\s*$"
HEADED_BRACKETS = r"\s*[\(\[]\s*(?:[Ff][Oo][Rr]\s+)?([^)\]]{3,120})[\)\]]"
HEADED_LINE = r"\s*(?:[-–—:]\s*)?(?:for\s+)?([A-Z][^\n.;]{3,90})"
PLEADING_HEADING = (
    r"(?i)(?:(?:first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+|amended\s+|verified\s+|supplemental\s+|class\s+action\s+"
    r"|representative\s+|joint\s+)*(cross-?\s*complaint|complaint|petition)\s*(?:for\b[:\s]*)?"
)

# What a petition asks for, and case numbers of petitions.
PETITION_START = r"(?i)^\s*(amended|second amended|first amended|verified|supplemental)\s+"
PETITION_FOR = r"(?i)\bpetition\s+(?:for|to)\b[:\s]*([\s\S]*?)(?:\s+(?:filed by|\(transaction id|as to|no will filed|with will annexed|will annexed)\b|,|$)"
PETITION_OTHER = r"(?i)\bpetition\b[:\s]*([A-Za-z][^,(]{3,80})"
PETITION_NUMBER = r"^P(ES|ER|CN|TR|RO|FA|G)(?:\b|\d)"

# Filings that only speak of a pleading, and the kinds of pleading.
NOT_A_FILING = (
    r"(?i)\b(?:answer(?:ed)?\b|summons|order(?:s|ed)?\b|notice\b|declaration\b|opposition\b|reply\b|demurrer\b|motion\b|stipulation\b|memorandum\b"
    r"|points and authorities\b|proof of service\b|dismiss(?:al|ed)?\b|request for (?:dismissal|judicial notice)\b|case management\b"
    r"|amend(?:ed|ment) (?:order|judgment)\b|judgment\b|substitution\b|ex parte application\b|objection\b|supplement(?:al)?\b|response\b|joinder\b"
    r"|verification\b|certificate\b|cover sheet\b)"
)
PLEADING_KINDS = {
    "cross": r"\bcross-?\s*complaint\b|\bcounter-?\s*claim\b",
    "complaint": r"\bcomplaint\b",
    "petition": r"\bpetition\b",
}

# Ordinals of causes of action.
ORDINALS = (
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth",
    "fourteenth", "fifteenth", "sixteenth", "seventeenth", "eighteenth", "nineteenth", "twentieth", "twenty-first", "twenty-second",
    "twenty-third", "twenty-fourth", "twenty-fifth",
)

# Causes that a combined caption stands for, and what is none.
CANONICAL_CAUSES = {
    "change of name": (("name-change", "Name change"),),
    "name change": (("name-change", "Name change"),),
    "gender": (("gender-change", "Gender change"),),
    "change of gender": (("gender-change", "Gender change"),),
    "gender change": (("gender-change", "Gender change"),),
    "change of name and gender": (("name-change", "Name change"), ("gender-change", "Gender change")),
    "residency verified": (),
}

# Names of the query language and the fields they stand for.
QUERY_FIELDS = {"dn": "decreed_name"}

# Columns of a ranked row's detail.
DETAIL_COLUMNS = (
    "ordinal", "rank", "case_number", "case_title", "case_profile_path", "judgment_date", "judgment_kind", "judgment_amount",
    "judgment_is_satisfied", "satisfaction_state", "satisfaction_status_label", "attorney_count", "attorney_names",
    "attorneys_truncated", "principal_amount", "interest_amount", "costs_amount", "fees_amount", "reimbursement_amount",
    "sanctions_amount", "damages_amount", "restoration_amount", "matter_type", "matter_type_key", "matter_category",
    "matter_category_key",
)

# Columns that a row of an entity keeps in its year partitions.
YEAR_COLUMNS = {
    "attorneys": (
        "entity_kind", "entity_id", "display_name", "case_count", "civil_case_count", "criminal_case_count", "case_category_counts",
        "appearance_count", "bar_number", "source_bar_number", "resolved_bar_number", "bar_evidence", "bar_evidence_classes",
        "match_status", "match_method", "profile_fetched_at", "state_bar_match_method", "state_bar_profile_fetched_at",
        "state_bar_profile_url", "state_bar_status", "state_bar_employer", "state_bar_address", "state_bar_city", "court_roles",
        "court_role_history", "jurisdiction", "latest_firm_name", "source", "confidence",
    ),
    "firms": (
        "entity_kind", "entity_id", "display_name", "case_count", "civil_case_count", "criminal_case_count", "case_category_counts",
        "source", "attorney_count", "firm_category", "government_firm_category",
    ),
    "litigants": (
        "entity_kind", "entity_id", "display_name", "norm_key", "case_count", "civil_case_count", "criminal_case_count",
        "case_category_counts", "represented_case_count", "pro_per_case_count", "representation_status", "entity_type",
        "entity_subtype", "confidence", "confidence_tier", "name_source", "manual_review_state", "party_types",
        "title_iv_d_case_count", "ordinary_party_case_count", "association_capacity_counts", "interpreted_party_types",
    ),
    "judges": (
        "entity_kind", "entity_id", "display_name", "case_count", "civil_case_count", "criminal_case_count", "case_category_counts",
        "officer_type", "roster_status", "roster_title", "dept", "code", "codes", "roster_departments", "name_variants",
        "legacy_keys", "former", "commissioner", "source",
    ),
}

# Order of record categories in histograms.
CATEGORY_ORDER = ("Civil", "Family", "Probate", "Appeals", "Criminal", "Legacy", "Other")

# Authority of tag sources.
TAG_AUTHORITY = {"judicial_council": 4, "docket": 3, "ocr": 2, "tentative": 1}

# Phrases that end a caption's list of causes.
STOP_PHRASES = (
    "DEMAND FOR JURY", "DEMAND FOR A JURY", "JURY TRIAL DEMAND", "JURY TRIAL", "JURY DEMAND", "REQUEST FOR INJUNCT",
    "REQUEST FOR JURY", "AMOUNT DEMANDED", "UNLIMITED CIVIL", "LIMITED CIVIL", "DEMAND EXCEEDS", "DEMAND UNDER", "INTRODUCTION",
    "NATURE OF THE ACTION", "NATURE OF ACTION", "GENERAL ALLEGATIONS", "FACTS COMMON TO", "COMMON ALLEGATIONS",
    "PRELIMINARY ALLEGATIONS", "PRELIMINARY STATEMENT", "PARTIES AND", "THE PARTIES", "SUMMARY OF", "STATEMENT OF FACTS",
    "JURISDICTION AND VENUE", "VENUE AND JURISDICTION", "EXEMPT FROM FILING", "COMPLAINT FOR DAMAGES CASE NO",
)

# attorneys' names that are no names.
NAME_ARTEFACT = r"(?i)^\s*(?:depositor,\s*will|will\s+depositor|trust\s+depositor|settlement\s+attorney\s*\d*|visiting\s+judge|unknown\s+judge)\s*$"

# Names of outcomes by kind of event.
EVENT_LABELS = {
    "amended_judgment": "Amended judgment",
    "appeal_affirmed": "Appeal affirmed",
    "appeal_dismissed": "Appeal dismissed",
    "appeal_mixed": "Mixed appellate disposition",
    "appeal_modified": "Appeal modified",
    "appeal_reference": "Appeal reference",
    "appeal_reversed": "Appeal reversed",
    "default_judgment": "Default judgment",
    "declaratory/injunctive": "Declaratory or injunctive judgment",
    "dismissal": "Dismissal",
    "family_custody_modification": "Child custody modification",
    "family_custody_order": "Child custody order",
    "family_judgment": "Family judgment",
    "family_order_reference": "Family-order reference",
    "family_property_judgment": "Family property judgment",
    "family_restraining_order": "Family restraining order",
    "family_support_modification": "Support modification",
    "family_support_order": "Support order",
    "judgment": "Judgment",
    "judgment_of_dismissal": "Judgment of dismissal",
    "judgment_reference": "Judgment reference",
    "monetary_judgment": "Money judgment",
    "partial_satisfaction": "Partial satisfaction",
    "possession": "Possession judgment",
    "probate_account_order": "Probate account order",
    "probate_decree": "Probate decree",
    "probate_discharge_order": "Probate discharge order",
    "probate_letters_order": "Probate letters order",
    "probate_order_reference": "Probate-order reference",
    "renewal": "Judgment renewal",
    "renewal_reference": "Renewal reference",
    "satisfaction": "Satisfaction",
    "satisfaction_reference": "Satisfaction reference",
    "take_nothing": "Take-nothing judgment",
    "unknown_end_state": "Unresolved judgment reference",
    "vacatur": "Vacatur",
    "vacatur_reference": "Vacatur reference",
    "writ_denied": "Writ denied",
    "writ_dismissed": "Writ dismissed",
    "writ_disposition": "Writ disposition",
    "writ_granted": "Writ granted",
    "writ_interim_order": "Interim writ order",
    "writ_reference": "Writ reference",
}

# Names of the domains of outcomes.
DOMAIN_LABELS = {
    "appellate_disposition": "Appellate disposition",
    "child_custody": "Child custody",
    "child_support": "Child support",
    "criminal_sentence": "Criminal sentence",
    "declaratory_injunctive": "Declaratory or injunctive",
    "dismissal": "Dismissal",
    "domestic_violence_restraint": "Domestic violence restraint",
    "family_property": "Family property",
    "family_status": "Family status",
    "money_judgment": "Money judgment",
    "nonoperative_reference": "Nonoperative reference",
    "partial_satisfaction": "Partial satisfaction",
    "possession": "Possession",
    "probate_account": "Probate account",
    "probate_discharge": "Probate discharge",
    "probate_distribution": "Probate distribution",
    "probate_letters": "Probate letters",
    "renewal": "Renewal",
    "satisfaction": "Satisfaction",
    "spousal_support": "Spousal support",
    "take_nothing": "Take nothing",
    "unknown_end_state": "Unresolved reference",
    "vacatur": "Vacatur",
    "writ_petition": "Writ petition",
}

# Results in words by kind of event.
EVENT_RESULTS = {
    "amended_judgment": "Amended judgment entered",
    "appeal_affirmed": "Judgment or order affirmed on appeal",
    "appeal_dismissed": "Appeal dismissed",
    "appeal_modified": "Judgment or order modified on appeal",
    "appeal_reversed": "Judgment or order reversed on appeal",
    "criminal_sentence": "Criminal sentence entered",
    "criminal_sentence_modification": "Criminal sentence modified",
    "default_judgment": "Default judgment entered",
    "declaratory/injunctive": "Declaratory or injunctive judgment entered",
    "dismissal": "Dismissal entered",
    "family_judgment": "Family law judgment entered",
    "family_property_judgment": "Family property judgment entered",
    "family_restraining_order": "Domestic violence restraining order entered",
    "judgment": "Judgment entered",
    "judgment_of_dismissal": "Judgment of dismissal entered",
    "monetary_judgment": "Money judgment entered",
    "name_change_decree": "Name change decree entered",
    "partial_satisfaction": "Partial satisfaction of judgment on file",
    "possession": "Possession judgment entered",
    "probate_account_order": "Probate account order entered",
    "probate_decree": "Probate decree entered",
    "probate_discharge_order": "Probate discharge order entered",
    "probate_distribution_order": "Probate distribution order entered",
    "probate_letters_order": "Probate letters order entered",
    "remittitur": "Remittitur issued",
    "renewal": "Renewal of judgment on file",
    "satisfaction": "Satisfaction of judgment on file",
    "take_nothing": "Take nothing judgment entered",
    "vacatur": "Judgment or order vacated",
    "writ_denied": "Writ denied",
    "writ_dismissed": "Writ petition dismissed",
    "writ_disposition": "Writ disposition entered",
    "writ_granted": "Writ granted",
    "writ_interim_order": "Interim writ order entered",
}

# Results in words by domain.
DOMAIN_RESULTS = {
    "appellate_disposition": "Appellate disposition entered",
    "child_custody": "Child custody order entered",
    "child_support": "Child support order entered",
    "criminal_sentence": "Criminal sentence entered",
    "declaratory_injunctive": "Declaratory or injunctive judgment entered",
    "dismissal": "Dismissal entered",
    "domestic_violence_restraint": "Domestic violence restraining order entered",
    "family_property": "Family property judgment entered",
    "family_status": "Family law judgment entered",
    "family_support": "Family support order entered",
    "money_judgment": "Money judgment entered",
    "name_change": "Name change decree entered",
    "partial_satisfaction": "Partial satisfaction of judgment on file",
    "possession": "Possession judgment entered",
    "probate_account": "Probate account order entered",
    "probate_discharge": "Probate discharge order entered",
    "probate_distribution": "Probate distribution order entered",
    "probate_letters": "Probate letters order entered",
    "renewal": "Renewal of judgment on file",
    "satisfaction": "Satisfaction of judgment on file",
    "spousal_support": "Spousal support order entered",
    "take_nothing": "Take nothing judgment entered",
    "vacatur": "Judgment or order vacated",
    "writ_petition": "Writ disposition entered",
}
SUPPORT_DOMAINS = {"child_support": "Child support", "spousal_support": "Spousal support", "family_support": "Family support"}

# Kinds to which satisfaction does not apply, and those to which it does without a summary.
NEVER_SATISFIED = ("declaratory/injunctive", "name_change_decree", "take_nothing")
SATISFIABLE = (
    "amended_judgment", "default_judgment", "dismissal", "judgment", "judgment_of_dismissal", "monetary_judgment", "possession",
    "stipulated_judgment",
)

# Messages of a manifest that cannot be used, by code.
MANIFEST_MESSAGES = {
    "manifest_invalid": "Judgment data error: the evidence manifest is missing or invalid.",
    "manifest_layout_incompatible": "Judgment data error: the evidence manifest uses an incompatible shard layout.",
    "manifest_rule_incompatible": "Judgment data error: the evidence manifest identifies an incompatible extraction rule.",
    "manifest_rule_version_invalid": "Judgment data error: the evidence manifest has no valid extraction rule version.",
    "manifest_source_snapshot_invalid": "Judgment data error: the evidence manifest has no valid source snapshot.",
}

# Titles dropped from officers' keys, honorifics in front of names, and pro tem in front or behind.
OFFICER_TITLES = r"\b(?:hon|honorable|judge|justice|commissioner|comm|pro\s*tem|dept|department)\b\.?"
HONORIFICS = r"(?i)^(?:(?:(?:the\s+)?hon(?:orable)?|judge|justice|commissioner|comm|mr|mrs|ms|dr)\b\.?\s*)+"
PRO_TEM_LEAD = r"(?i)^(?:(?:(?:the\s+)?hon(?:orable)?|the|justice)\b\.?\s*)*(?:judge\s+)?pro\s*[- ]?\s*tem(?:pore)?(?:\s+judge)?\b[\s:,-]*"
PRO_TEM_TAIL = r"(?i)[\s,(:-]+(?:judge\s+)?pro\s*[- ]?\s*tem(?:pore)?\)?\s*$"

# Words dropped from category keys, statuses of open cases, reasons of complete deferrals.
SMALL_WORDS = ("the", "a", "an", "of", "for", "to")
OPEN_STATUSES = ("active", "case active", "open", "case open", "pending", "case pending")
DEFERRAL_REASONS = ("first_pass_complaints_petitions_and_orders", "legacy_pre_byte_capture")
