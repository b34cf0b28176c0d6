"""Patterns, labels and lookup lists that results depend on."""

# Identifier patterns (case-insensitive, whole value).
DOI_PATTERN = r"(?i)^10\.\d{4,9}/[-._;()/:a-z0-9]+$"
ORCID_PATTERN = r"(?i)^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"
ROR_PATTERN = r"(?i)^https://ror\.org/[a-z0-9]{9}$"

# Confidence labels of duplicate candidates and findings.
EXACT_MATCH = "exact_match"
STRONG_MATCH = "strong_match"
POSSIBLE_MATCH = "possible_match"
MANUAL_REVIEW_NEEDED = "manual_review_needed"

# Messages of anomaly findings, for people; no result depends on them.
MESSAGES = {
    "publication_incomplete": "no DOI, no source id and no year: nothing to match this publication by",
    "publication_doi": "the DOI does not have the form of a DOI",
    "researcher_orcid": "the ORCID does not have the form of an ORCID",
    "researcher_name": "a name of one word is too little to match people by",
    "organization_ror": "the ROR id does not have the form of a ROR address",
    "organization_name": "no name is left after normalizing: nothing to match this organization by",
}

# Access values that count as open.
OPEN_ACCESS_VALUES = ("open", "openaccess", "open access")

# Relation names that state an affiliation.
AFFILIATION_RELATIONS = ("hasauthorinstitution", "isauthorinstitutionof")

# Key order for reading one text out of a coded value.
VALUE_KEYS = ("value", "label", "code", "name")
RELATION_KEYS = ("name", "value", "code", "label")
LANGUAGE_CODE_KEYS = ("code", "iso", "isoCode", "value")
LANGUAGE_LABEL_KEYS = ("label", "name")
COUNTRY_KEYS = ("code", "countryCode", "iso", "isoCode")

# Prefix of an organization id that is not yet stable.
PENDING_ORG_PREFIX = "pending_org_"

# Scores of an organization name against a dictionary alias.
SCORE_EQUAL = 120
SCORE_ALIAS_IN_NAME = 100
SCORE_NAME_IN_ALIAS = 80
SCORE_SAME_COUNTRY = 10
SCORE_OTHER_COUNTRY = -25
MIN_NAME_IN_ALIAS = 10

# Alliance universities: code, name, country, aliases.
ALLIANCE_UNIVERSITIES = (
    ("karlstad", "Karlstad University", "SE", ("Karlstad University", "Karlstads universitet")),
    ("vaasa", "University of Vaasa", "FI", ("University of Vaasa", "Universita di Vaasa", "Università di Vaasa")),
    ("btu", "Brandenburg University of Technology", "DE",
     ("Brandenburg University of Technology", "Brandenburg University of Technology Cottbus-Senftenberg", "BTU", "BUT")),
    ("poznan-tech", "Poznan University of Technology", "PL",
     ("Poznan University of Technology", "Politechnika Poznanska", "Politechnika Poznańska", "PUT")),
    ("unict", "University of Catania", "IT",
     ("University of Catania", "Universita di Catania", "Università di Catania",
      "Universita degli Studi di Catania", "UNICT")),
    ("peloponnese", "University of the Peloponnese", "GR",
     ("University of the Peloponnese", "Universita del Peloponneso", "Università del Peloponneso",
      "Panepistimio Peloponnisou")),
    ("cantabria", "University of Cantabria", "ES",
     ("University of Cantabria", "Universidad de Cantabria", "Universita di Cantabria",
      "Università di Cantabria", "UC")),
    ("viseu", "Polytechnic Institute of Viseu", "PT",
     ("Polytechnic Institute of Viseu", "Instituto Politecnico de Viseu", "Instituto Politécnico de Viseu",
      "Istituto Politecnico di Viseu", "IPV")),
    ("umons", "Université de Mons", "BE", ("Universite de Mons", "Université de Mons", "University of Mons", "UMONS")),
    ("uphf", "Université Polytechnique Hauts-de-France", "FR",
     ("Université Polytechnique Hauts-de-France", "Universite Polytechnique Hauts-de-France",
      "University Polytechnic Hauts-de-France", "UPHF", "Universite de Valenciennes", "Université de Valenciennes")),
)
