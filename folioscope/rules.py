"""Rule tables, dictionaries and thresholds the results depend on."""

from __future__ import annotations

# --- Fixed values: thresholds -------------------------------------------------
CAR_THRESHOLD = 0.65
CARD_THRESHOLD = 0.5
DAMAGE_THRESHOLD = 0.50
DETECTOR_FLOOR = 0.50
NMS_IOU = 0.45
FRAME_SIZE = 640
MINOR_MAX_AREA = 0.05
MODERATE_MAX_AREA = 0.15
CENTER_REACH = 0.3
MAX_UPLOAD_BYTES = 26_214_400
CHUNK_CHARS = 1200
CHUNK_OVERLAP = 3
AUTO_ACCEPT = 0.90
REJECT_BELOW = 0.60
HISTOGRAM_BUCKETS = (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)

# --- Fixed values: vocabularies -----------------------------------------------
PROCESS_TYPES = ("car", "mulkiya", "pdf", "file")
VIEW_PRIORITY = ("front", "back", "left", "right")
DAMAGE_CLASSES = ("car-part-crack", "deformation", "flat-tire", "glass-crack", "lamp-crack", "scratches")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".webp")
TEXT_SUFFIXES = (
    ".md", ".txt", ".log", ".py", ".js", ".ts", ".css", ".html", ".xml", ".yaml", ".yml", ".ini", ".cfg",
)
ARCHIVE_SUFFIXES = (".zip", ".docx", ".xlsx", ".pptx")
SERVER_TIME_HEADERS = ("X-Process-Time-ms", "X-Process-Time-MS", "X-Process-Time")
DIGIT_ALLOWLIST = "0123456789"
LETTER_ALLOWLIST = "ABCDEFGHJKLMNPQRSTUVWXYZ"

# --- Fixed values: media type by file suffix ----------------------------------
SUFFIX_MEDIA_TYPES = {
    ".pdf": "application/pdf",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
    ".bmp": "image/bmp",
    ".tif": "image/tiff",
    ".tiff": "image/tiff",
    ".gif": "image/gif",
    ".txt": "text/plain",
    ".html": "text/html",
    ".htm": "text/html",
    ".css": "text/css",
    ".csv": "text/csv",
    ".tsv": "text/tab-separated-values",
    ".xml": "text/xml",
    ".py": "text/x-python",
    ".md": "text/markdown",
    ".js": "text/javascript",
    ".json": "application/json",
    ".zip": "application/zip",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    ".pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
}
DEFAULT_MEDIA_TYPE = "application/octet-stream"

# --- Fixed values: parts at risk by damage class and image region -------------
PARTS_AT_RISK = {
    ("car-part-crack", "top_left"): ["hood", "left_fender", "windshield_frame"],
    ("car-part-crack", "top_right"): ["hood", "right_fender", "windshield_frame"],
    ("car-part-crack", "bottom_left"): ["front_bumper", "radiator_grille", "left_rocker_panel"],
    ("car-part-crack", "bottom_right"): ["front_bumper", "radiator_grille", "right_rocker_panel"],
    ("car-part-crack", "center"): ["door_panel", "body_frame", "sill"],
    ("deformation", "top_left"): ["hood", "left_fender", "left_a_pillar"],
    ("deformation", "top_right"): ["hood", "right_fender", "right_a_pillar"],
    ("deformation", "bottom_left"): ["front_bumper", "radiator_support", "left_frame_rail"],
    ("deformation", "bottom_right"): ["front_bumper", "radiator_support", "right_frame_rail"],
    ("deformation", "center"): ["door_panel", "b_pillar", "body_frame"],
    ("flat-tire", "top_left"): ["left_front_tire", "left_front_rim", "left_front_brake_caliper"],
    ("flat-tire", "top_right"): ["right_front_tire", "right_front_rim", "right_front_brake_caliper"],
    ("flat-tire", "bottom_left"): ["left_rear_tire", "left_rear_rim", "left_rear_suspension"],
    ("flat-tire", "bottom_right"): ["right_rear_tire", "right_rear_rim", "right_rear_suspension"],
    ("flat-tire", "center"): ["tire", "rim", "suspension"],
    ("glass-crack", "top_left"): ["windshield", "left_a_pillar", "wiper_linkage"],
    ("glass-crack", "top_right"): ["windshield", "right_a_pillar", "wiper_linkage"],
    ("glass-crack", "bottom_left"): ["rear_windshield", "left_c_pillar", "rear_wiper"],
    ("glass-crack", "bottom_right"): ["rear_windshield", "right_c_pillar", "rear_wiper"],
    ("glass-crack", "center"): ["side_window", "door_seal", "window_regulator"],
    ("lamp-crack", "top_left"): ["left_headlight_assembly", "left_indicator", "left_daytime_running_light"],
    ("lamp-crack", "top_right"): ["right_headlight_assembly", "right_indicator", "right_daytime_running_light"],
    ("lamp-crack", "bottom_left"): ["left_tail_light", "left_reverse_light", "left_brake_light"],
    ("lamp-crack", "bottom_right"): ["right_tail_light", "right_reverse_light", "right_brake_light"],
    ("lamp-crack", "center"): ["lamp_assembly", "indicator"],
    ("scratches", "top_left"): ["hood", "left_fender"],
    ("scratches", "top_right"): ["hood", "right_fender"],
    ("scratches", "bottom_left"): ["front_bumper", "left_rocker_panel"],
    ("scratches", "bottom_right"): ["rear_bumper", "right_rocker_panel"],
    ("scratches", "center"): ["door_panel"],
}

# --- Fixed values: repair action and replacement by damage class and severity -
REPAIRS = {
    ("car-part-crack", "minor"): ("Repair — filler + repaint", False),
    ("car-part-crack", "moderate"): ("Replace cracked part", True),
    ("car-part-crack", "severe"): ("Replace part + inspect structural frame", True),
    ("deformation", "minor"): ("Repair — paintless dent repair (PDR)", False),
    ("deformation", "moderate"): ("Repair — PDR + repaint panel", False),
    ("deformation", "severe"): ("Replace panel + inspect frame rails", True),
    ("flat-tire", "minor"): ("Repair — patch tire", False),
    ("flat-tire", "moderate"): ("Replace tire", True),
    ("flat-tire", "severe"): ("Replace tire + inspect rim and suspension", True),
    ("glass-crack", "minor"): ("Repair — resin injection (if single crack)", False),
    ("glass-crack", "moderate"): ("Replace glass panel", True),
    ("glass-crack", "severe"): ("Replace glass + inspect frame seals", True),
    ("lamp-crack", "minor"): ("Replace lamp lens", True),
    ("lamp-crack", "moderate"): ("Replace full lamp assembly", True),
    ("lamp-crack", "severe"): ("Replace lamp assembly + inspect mount", True),
    ("scratches", "minor"): ("Repair — machine polish + touch-up paint", False),
    ("scratches", "moderate"): ("Repair — repaint panel", False),
    ("scratches", "severe"): ("Repair — filler + full panel repaint", False),
}
DEFAULT_REPAIR = ("Manual inspection required", False)

# --- Fixed values: part names seen from each side of the car ------------------
VIEW_PART_NAMES = {
    "front": {
        "left_tail_light": "left_headlight_assembly",
        "right_tail_light": "right_headlight_assembly",
        "left_reverse_light": "left_daytime_running_light",
        "right_reverse_light": "right_daytime_running_light",
        "left_brake_light": "left_indicator",
        "right_brake_light": "right_indicator",
        "rear_windshield": "windshield",
        "rear_bumper": "front_bumper",
        "rear_wiper": "wiper_linkage",
    },
    "back": {},
    "left": {
        "left_tail_light": "left_headlight_assembly",
        "right_tail_light": "left_tail_light",
        "left_reverse_light": "left_daytime_running_light",
        "left_brake_light": "left_indicator",
        "rear_windshield": "left_rear_window",
        "wiper_linkage": "left_a_pillar",
    },
    "right": {
        "right_tail_light": "right_headlight_assembly",
        "left_tail_light": "right_tail_light",
        "right_reverse_light": "right_daytime_running_light",
        "right_brake_light": "right_indicator",
        "rear_windshield": "right_rear_window",
        "wiper_linkage": "right_a_pillar",
    },
}

# --- Fixed values: the entry for damage that could not be localised -----------
GENERAL_DAMAGE_TYPE = "general-damage"
GENERAL_DAMAGE_ACTION = (
    "Visual inspection required — damage detected but type could not be localized automatically"
)
NO_CAR_MESSAGE = "No car images detected. Please submit images of a vehicle."
PLATE_UNAVAILABLE = "plate detection unavailable"

# --- Fixed values: error codes, HTTP status, retryable by code ----------------
ERROR_CODES = [
    ("VALIDATION_ERROR", 400, False),
    ("UNSUPPORTED_MEDIA", 415, False),
    ("PAYLOAD_TOO_LARGE", 413, False),
    ("NOT_FOUND", 404, False),
    ("MODEL_UNAVAILABLE", 503, True),
    ("CIRCUIT_OPEN", 503, True),
    ("DEPENDENCY_TIMEOUT", 504, True),
    ("PIPELINE_FAILURE", 502, False),
    ("INTERNAL_ERROR", 500, False),
]
# --- Fixed values: error code by HTTP status and by exception class -----------
STATUS_CODES = {
    400: "VALIDATION_ERROR",
    404: "NOT_FOUND",
    413: "PAYLOAD_TOO_LARGE",
    415: "UNSUPPORTED_MEDIA",
    503: "MODEL_UNAVAILABLE",
    504: "DEPENDENCY_TIMEOUT",
}
EXCEPTION_CODES = {
    "FileNotFoundError": "MODEL_UNAVAILABLE",
    "TimeoutError": "DEPENDENCY_TIMEOUT",
    "ValidationError": "VALIDATION_ERROR",
    "UnsupportedMediaError": "UNSUPPORTED_MEDIA",
    "PayloadTooLargeError": "PAYLOAD_TOO_LARGE",
    "ModelUnavailableError": "MODEL_UNAVAILABLE",
    "CircuitOpenError": "CIRCUIT_OPEN",
    "DependencyTimeoutError": "DEPENDENCY_TIMEOUT",
    "PipelineFailureError": "PIPELINE_FAILURE",
}

# --- Fixed values: fields of a vehicle registration card ----------------------
RECORD_FIELDS = (
    "plate_number", "plate_text", "vehicle_type", "make", "model", "color", "year", "model_year",
    "country_of_origin", "vin_or_chassis", "engine_number", "engine_cc", "empty_weight_kg", "max_load_kg",
    "seats", "issue_date", "expiry_date", "owner_name", "notes",
)
CRITICAL_FIELDS = (
    "plate_number", "vin_or_chassis", "engine_cc", "empty_weight_kg", "max_load_kg", "seats", "issue_date", "year",
)
DIGIT_MATCH_FIELDS = ("plate_number", "year", "engine_cc", "empty_weight_kg", "max_load_kg", "seats")
EXTRACT_NOTE = "Heuristic extraction."
AUXILIARY_NOTE = "Heuristic extraction with auxiliary English OCR fallback."

FIELD_LABELS_EN = {
    "plate_number": "Plate number",
    "plate_text": "Plate letters",
    "vehicle_type": "Vehicle type",
    "make": "Make",
    "model": "Model",
    "color": "Color",
    "year": "Model year",
    "vin_or_chassis": "VIN or chassis number",
    "engine_cc": "Engine capacity (cc)",
    "empty_weight_kg": "Empty weight (kg)",
    "max_load_kg": "Maximum load (kg)",
    "seats": "Seats",
    "issue_date": "Issue date",
    "expiry_date": "Expiry date",
    "owner_name": "Owner name",
    "notes": "Notes",
}

FIELD_LABELS_AR = {
    "plate_number": "رقم اللوحة",
    "vehicle_type": "نوع المركبة",
    "make": "الصانع",
    "model": "الطراز",
    "color": "اللون",
    "year": "سنة الصنع",
    "model_year": "سنة الطراز",
    "country_of_origin": "بلد المنشأ",
    "vin_or_chassis": "رقم الشاصي",
    "engine_number": "رقم المحرك",
    "engine_cc": "سعة المحرك",
    "empty_weight_kg": "الوزن فارغ",
    "max_load_kg": "الحمولة القصوى",
    "seats": "عدد المقاعد",
    "issue_date": "تاريخ الإصدار",
    "expiry_date": "تاريخ الانتهاء",
    "owner_name": "اسم المالك",
}

# --- Fixed values: Arabic to English dictionary for card text -----------------
ARABIC_ENGLISH = {
    "خصوصي": "Private",
    "بب": "Ba Ba (Arabic plate letters)",
    "تويوتا": "Toyota",
    "كورولا": "Corolla",
    "صالون": "Sedan",
    "تويوتا صالون كورولا": "Toyota Corolla sedan",
    "ابيض": "White",
    "أبيض": "White",
    "الولايات": "United States",
    "المتحدة الامريكية": "United States of America",
    "الولايات المتحدة الامريكية": "United States of America",
    "عمان": "Oman",
    "سلطنة": "Sultanate",
    "سلطنة عمان": "Sultanate of Oman",
    "شرطة": "Police",
    "شرطة عمان": "Oman Police",
    "السلطائية": "Royal",
    "الادارة": "Directorate",
    "العامة": "General",
    "للمرور": "Traffic",
    "رخصة": "License",
    "مركبة": "Vehicle",
    "رخصة مركبة": "Vehicle license",
    "رقم": "Number",
    "اللوحة": "Plate",
    "الوحة": "Plate",
    "نوع": "Type",
    "نوع الوحة": "Plate type",
    "نوع المركبة": "Vehicle type",
    "اللون": "Color",
    "المنشاء": "Origin",
    "سنة الطرار": "Model year",
    "سنة الصلع": "Manufacture year",
    "سعة المحرك": "Engine capacity",
    "الوزن": "Weight",
    "فارغ": "Empty",
    "الحمولة": "Load",
    "القصوى": "Maximum",
    "كجم": "kg",
    "عدد الركاب": "Number of passengers",
    "عدد المحاور": "Number of axles",
    "رقم الاعدةالشاص": "Chassis number",
    "رقم المحرة": "Engine number",
    "الرخصة من": "License from",
    "صلاحية": "Validity",
}

# --- Fixed values: terms the card extractor looks for -------------------------
FIELD_LABEL_TERMS = (
    "اللوحة", "الوحة", "نوع", "المركبة", "اللون", "المنشاء", "سنة", "الطرار", "الصنع", "الصلع", "المحرك",
    "الوزن", "فارغ", "الحمولة", "الركاب", "المحاور", "الشاص", "الشاصي", "القاعدة", "الاعدة", "المحرة",
    "الرخصة", "صلاحية",
)
PLATE_LABELS = ("اللوحة", "الوحة", "رقم اللوحة", "رقم الوحة", "ﺍﻟﻠﻮﺣﺔ")
PLATE_LABEL_EXCLUDE = "نوع"
PLATE_TOKEN_SKIP = ("رقم", "اللوحة", "الوحة", "نوع", "خصوصي")
VIN_LABELS = ("الشاص", "الشاصي", "شاصي", "chassis", "vin", "رقم القاعدة", "القاعدة", "الاعدة")
YEAR_LABELS = ("الصنع", "الصلع")
MAKES = ("تويوتا", "نيسان", "هيونداي", "كيا", "هوندا", "مرسيدس", "بي ام", "BMW", "LEXUS", "لكزس")
MODELS = ("كورولا", "كامري", "يارس", "ألتِيما", "التيما", "صني")
COLOR_LABEL = "اللون"
ORIGIN_HEAD = "الولايات"
ORIGIN_TAILS = ("المتحدة", "الامريكية")
ORIGIN_VALUE = "الولايات المتحدة الامريكية"
PRIVATE_TYPE = "خصوصي"
ENGINE_LABEL = "المحرك"
EMPTY_WEIGHT_LABELS = ("فارغ", "الوزن")
MAX_LOAD_LABEL = "الحمولة"
SEATS_LABEL = "الركاب"
VIN_ARTIFACTS = (
    "VEHICLE", "MOTOR", "ENGINE", "LICENSE", "LCENSE", "TIRAFIIC", "SULTANATE", "OMAN", "POLICE", "ROYA",
    "ROYAL", "KINGDOM", "GENERALOFTRAFFIC", "GENERAL", "TRAFFIC",
)
VIN_COMPOUND_ARTIFACTS = (
    "VEHICLEMOTOR", "MOTORVEHICLE", "ENGINEMOTOR", "MOTORENGINE", "POLICEOMATIC", "SULTANATEOMAN",
    "DIRGENERALOFTRAFFIC",
)

# --- Fixed values: patterns (explicit classes, so Java and RE2 agree) ---------
SPACE_CLASS = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ARABIC_CLASS = r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}"
DATE_PATTERN = r"(?U)\b\d{2,4}/\d{1,2}/\d{1,2}\b"
LOOSE_DATE_PATTERN = r"(?U)\d{2,4}/\d{1,2}/\d{1,2}"
MASKED_ID_PATTERN = r"(?U)(?:x{4}|X{4}|\*{4})\s*(?:x{4}|X{4}|\*{4})\s*\d{4}"
SPACED_ID_PATTERN = r"(?U)\b\d{4}\s+\d{4}\s+\d{4}\b"
BIRTH_PATTERN = r"(?U)\b(?:dob|date of birth|year of birth|yob|birth)\b"
BIRTH_DATE_PATTERN = r"(?U)\b\d{2}[/-]\d{2}[/-]\d{4}\b"
GENDER_PATTERN = r"(?U)\b(?:male|female|transgender|m|f)\b"
ADDRESS_PATTERN = r"(?U)\b(?:address|s/o|d/o|w/o|c/o|pin|pincode)\b"
