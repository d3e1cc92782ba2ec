"""Cases of the validators with the verdicts that they must give: names made up here, and a few listed values."""

#: (raw text, preceding words, accepted, confidence, needs review, reason, category)
PERSON_CASES = [
    ("Marta Lindqvist", "", True, 0.80, False, "accepted", "PERSON"),
    ("Marta Ilse Lindqvist", "", True, 0.80, False, "accepted", "PERSON"),
    ("Marta Ilse Lindqvist", "our director", True, 0.90, False, "accepted", "PERSON"),
    ("Tomas Okoro", "signed by", True, 0.90, False, "accepted", "PERSON"),
    ("Tomas", "contact mr.", True, 0.75, True, "accepted", "PERSON"),
    ("Tomas", "", False, 0.0, False, "single_token_without_context", "PERSON"),
    ("MARTA ILSE LINDQVIST", "", True, 0.75, True, "accepted", "PERSON"),
    ("TOMAS OKORO", "", False, 0.0, False, "allcaps_metric", "PERSON"),
    ("T. Okoro", "", False, 0.0, False, "section_heading", "PERSON"),
    ("Lindqvist Harbour Works Private Limited", "", True, 0.90, False, "company_suffix", "COMPANY"),
    ("Tomas Okoro 2nd", "", False, 0.0, False, "special_chars", "PERSON"),
    ("Riverside Branch", "", False, 0.0, False, "role_noun_suffix", "PERSON"),
    ("Harbour Port Agents", "", False, 0.0, False, "role_noun_suffix", "PERSON"),
    ("Elm Village", "", False, 0.0, False, "location_pattern", "PERSON"),
    ("Okoro Park Lane", "", False, 0.0, False, "token_blocklist", "PERSON"),
    ("Tomas Okoro*#&", "", True, 0.80, False, "accepted", "PERSON"),
    ("Zoë Ångström-Núñez", "", True, 0.80, False, "accepted", "PERSON"),
    # Entries of the lists.
    ("Offer", "", False, 0.0, False, "blocklist_match", "PERSON"),
    ("Floor Price", "", False, 0.0, False, "blocklist_match", "PERSON"),
    ("EBITDA CAGR", "", False, 0.0, False, "blocklist_match", "PERSON"),
    ("Bandra East", "", False, 0.0, False, "blocklist_match", "PERSON"),
]
#: (raw text, accepted, confidence, needs review, reason)
COMPANY_CASES = [
    ("Lindqvist Harbour Limited", True, 0.90, False, "company_suffix"),
    ("Okoro Timber Export Private Limited", True, 0.90, False, "company_suffix"),
    ("Okoro & Lindqvist LLP", True, 0.90, False, "company_suffix"),
    ("Harbour Savings Bank Limited", True, 0.90, False, "company_suffix"),
    ("Corporation Ltd", False, 0.0, False, "standalone_suffix"),
    ("Open Meadow Foundation", True, 0.85, False, "named_trust"),
    ("Lindqvist Family Trust", True, 0.85, False, "named_trust"),
    ("Harbour Dues Act", False, 0.0, False, "act_regulation_name"),
    ("THE DOCK WILL OPEN", False, 0.0, False, "allcaps_clause_fragment"),
    ("the second tranche", False, 0.0, False, "ipo_mechanism_pattern"),
    ("Harbour Dues&", False, 0.0, False, "no_positive_evidence"),
    ("Marta Lindqvist", False, 0.0, False, "no_positive_evidence"),
    ("#", False, 0.0, False, "empty_after_cleaning"),
    # Entries of the lists.
    ("SEBI", True, 0.60, True, "public_body"),
    ("National Stock Exchange of India", True, 0.60, True, "public_body"),
    ("Everest Family Trust", False, 0.0, False, "blocklist_match"),
    ("Audit Committee", False, 0.0, False, "blocklist_match"),
]
