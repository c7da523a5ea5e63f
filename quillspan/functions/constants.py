"""Fixed values of the labelling rules."""

# Fixed values that results depend on.
NEGATION_CUES = ("no", "not", "without", "never", "none", "n't", "absent", "denies", "denied", "deny", "negative", "unremarkable", "resolv", "cleared", "improved")
STOPWORDS = ("i", "a", "an", "the", "and", "or", "to", "for", "of", "in", "on", "at", "but", "so", "with", "after", "before", "from", "my", "me", "we", "our", "this", "that", "it", "is", "was", "are", "were")
ANATOMY = ("face", "skin", "arm", "arms", "leg", "legs", "hand", "hands", "eye", "eyes", "ear", "ears", "nose", "mouth", "lip", "lips", "head", "neck", "chest", "back", "stomach", "abdomen", "finger", "fingers", "toe", "toes", "foot", "feet", "scalp", "forehead", "cheek", "cheeks", "chin", "jaw")
EMOJI = (
    r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F700}-\x{1F77F}\x{1F780}-\x{1F7FF}\x{1F800}-\x{1F8FF}"
    r"\x{1F900}-\x{1F9FF}\x{1FA00}-\x{1FA6F}\x{1FA70}-\x{1FAFF}\x{2702}-\x{27B0}\x{24C2}-\x{1F251}]+"
)
TOKEN = r"(?U)\b\w[\w\-']*\b"
EMAIL = r"(?U)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"(?U)\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"
SSN = r"(?U)\b\d{3}-\d{2}-\d{4}\b"
FUZZY_THRESHOLD, MAX_TERM_WORDS, NEGATION_WINDOW, JACCARD_GATE, CONTENT_OVERLAP = 88.0, 6, 5, 40.0, 0.5
UNCERTAIN_LOW, UNCERTAIN_HIGH = 0.55, 0.75
STRATA_EDGES = (0.6, 0.7, 0.8, 0.9, 1.0)
CATEGORIES = {
    "cosmetics": ("cosmetics", "cosmetic", "makeup", "beauty"),
    "supplements": ("dietary supplement", "vitamin", "supplement"),
    "foods": ("food", "beverage", "drink"),
    "personal_care": ("personal care", "toiletries", "hygiene"),
    "baby": ("infant", "baby", "pediatric"),
}
NARRATIVE_COLUMNS = ("PRI_Reported Adverse Events", "PRI Reported Brand/Product Name", "Symptom(s)", "Symptom", "Adverse Event", "Event Description")
METADATA_COLUMNS = {
    "report_id": ("RA_Report #", "Report_ID", "Report Number"),
    "date_created": ("RA_CAERS Created Date", "Date_Created", "Created Date"),
    "product_type": ("Product Role", "Product_Role", "Role"),
    "product_name": ("PRI Reported Brand/Product Name", "Brand_Product_Name", "Product Name"),
    "age": ("CI_Age at Adverse Event", "Age", "Patient Age"),
    "gender": ("CI_Gender", "Gender", "Sex"),
    "outcomes": ("AEC_Outcome(s)", "Outcomes", "Outcome"),
}
