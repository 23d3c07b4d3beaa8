"""Controlled vocabularies and display names. Results depend on them as they stand."""

EXAM_TYPES = ["quiz", "test", "midsem", "compre", "lab_compre", "lab_quiz", "none", "unknown"]
DOC_TYPES = ["pyq", "solution", "notes", "slides", "tutorial", "assignment", "lab", "cheatsheet", "handout", "textbook", "grade_stats", "other", "unknown"]
LINK_STATUS = ["unknown", "ok", "broken", "no_access"]
METHODS = ["rule", "llm", "manual"]
SCOPES = ["pre_midsem", "post_midsem"]

DOC_TYPE_LABELS = {
    "pyq": "Past papers",
    "solution": "Solutions",
    "notes": "Notes",
    "slides": "Lecture slides",
    "tutorial": "Tutorials",
    "assignment": "Assignments",
    "lab": "Lab material",
    "cheatsheet": "Cheat sheets",
    "handout": "Handouts",
    "textbook": "Textbooks",
    "grade_stats": "Grade statistics",
    "other": "Other files",
    "unknown": "Unsorted files",
}
EXAM_TYPE_LABELS = {"quiz": "Quiz", "test": "Test", "midsem": "Midsem", "compre": "Compre", "lab_compre": "Lab compre", "lab_quiz": "Lab quiz"}
#: Exams that are shown, filtered and counted; "none" and "unknown" never are.
SHOWN_EXAMS = ["quiz", "test", "midsem", "compre", "lab_compre", "lab_quiz"]
NUMBERED_EXAMS = ["quiz", "test", "lab_quiz"]
KIND_ORDER = ["papers", "tutorial", "notes", "slides", "assignment", "lab", "cheatsheet"]
PAPER_TYPES = ["pyq", "solution"]

MATERIALS = ["papers", "solutions", "notes", "slides", "tutorials", "assignments", "labs"]
MATERIAL_TYPES = {
    "papers": ["pyq"],
    "solutions": ["solution"],
    "notes": ["notes", "handout", "cheatsheet"],
    "slides": ["slides"],
    "tutorials": ["tutorial"],
    "assignments": ["assignment"],
    "labs": ["lab"],
}
DEFAULT_MATERIALS = ["papers", "solutions", "notes", "slides", "tutorials"]
PAPER_MATERIALS = ["papers", "solutions"]

STOPWORDS = ["a", "an", "and", "the", "of", "in", "on", "for", "to", "with"]
INDEXABLE_EXTENSIONS = ["pdf", "ppt", "pptx", "doc", "docx", "png", "jpg", "jpeg"]
INDEXABLE_MIME = ["application/vnd.google-apps.document", "application/vnd.google-apps.presentation"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "svg", "bmp", "webp"]
ASSET_FOLDERS = ["images", "image", "img", "resources", "assets", "static", "css", "js", "script-dir"]
FACETS = ["course", "doc_type", "exam_type", "year"]
