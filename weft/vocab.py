"""Closed vocabularies and limits of the domain. All are fixed values."""

TOPICS = [
    "AI/ML Ứng dụng", "AI/ML Nghiên cứu", "DevTools & Frameworks", "Cloud & Infrastructure", "Data Engineering", "Security & Compliance",
    "Software Architecture", "Developer Experience", "Platform & API", "Market & Competition", "Legal & Regulation", "Team & Process",
]
EVENT_TYPES = [
    "Phát hành mới", "Thay đổi chính sách", "Cập nhật quy định", "Cảnh báo bảo mật", "Ngừng hỗ trợ/Deprecation", "Tín hiệu xu hướng",
    "Thảo luận cộng đồng", "Nghiên cứu/Paper", "Sự cố vận hành", "Breaking Change", "Benchmark/So sánh", "Hướng dẫn/Best Practice",
]
NATURES = ["Rủi ro", "Cơ hội", "Tuân thủ", "Thông tin chung", "Theo dõi"]
COMPANY_WIDE = "Toàn công ty"
ROLES = ["Data Analyst", "Data Scientist", "AI Engineer", "Data Engineer", "Security", "Dev", "Tech Lead", "Người dùng phổ thông", COMPANY_WIDE]
ACTION_TYPES = ["watch", "read", "test", "PoC", "roadmap"]
ROLE_URGENCY = ["high", "medium", "low"]
ADOPTION_RINGS = ["Adopt", "Trial", "Assess", "Hold"]
CONTENT_TYPES = ["practical", "strategic", "theoretical", "noise"]
INDICATORS = ["has_security_patch", "has_api_change", "has_migration_guide", "has_benchmark", "has_code_sample"]
PRACTICAL = ["has_security_patch", "has_api_change", "has_migration_guide"]

TRUST_SCORE = {"very_high": 0.95, "high": 0.80, "medium": 0.60, "low": 0.40, "unverified": 0.20}
TRUST_DEFAULT = 0.5
TRUST_ORDER = {"very_high": 0, "high": 1, "medium": 2, "low": 3, "unverified": 4}
TRUST_ORDER_DEFAULT = 99
IMPACT_BY_EVENT = {
    "Cảnh báo bảo mật": "Nghiêm trọng", "Breaking Change": "Nghiêm trọng", "Cập nhật quy định": "Cao", "Thay đổi chính sách": "Cao",
    "Ngừng hỗ trợ/Deprecation": "Cao", "Sự cố vận hành": "Cao", "Phát hành mới": "Trung bình", "Benchmark/So sánh": "Trung bình",
    "Hướng dẫn/Best Practice": "Trung bình", "Nghiên cứu/Paper": "Thấp", "Tín hiệu xu hướng": "Thấp", "Thảo luận cộng đồng": "Theo dõi",
}
IMPACT_DEFAULT = "Thấp"
EVENT_WEIGHT = {
    "Cảnh báo bảo mật": 1.0, "Breaking Change": 1.0, "Sự cố vận hành": 0.9, "Phát hành mới": 0.8, "Hướng dẫn/Best Practice": 0.7, "Cập nhật quy định": 0.7,
    "Thay đổi chính sách": 0.7, "Ngừng hỗ trợ/Deprecation": 0.8, "Benchmark/So sánh": 0.5, "Nghiên cứu/Paper": 0.3, "Tín hiệu xu hướng": 0.4, "Thảo luận cộng đồng": 0.2,
}
EVENT_WEIGHT_DEFAULT = 0.3
TACTICAL_EVENTS = ["Cảnh báo bảo mật", "Breaking Change", "Sự cố vận hành", "Phát hành mới", "Hướng dẫn/Best Practice"]
STRATEGIC_EVENTS = ["Tín hiệu xu hướng", "Thay đổi chính sách", "Cập nhật quy định", "Nghiên cứu/Paper"]
IMPACT_ORDER = {
    "Nghiêm trọng": 1, "Critical": 1, "Cao": 2, "High": 2, "Trung bình": 3, "Medium": 3, "Thấp": 4, "Low": 4, "Theo dõi": 5, "Watch": 5,
}
URGENCY_ORDER = {"critical": 1, "high": 2, "medium": 3, "low": 4}
ROLE_URGENCY_RANK = {"high": 3, "medium": 2, "low": 1}
IMPACT_RANK = {"Nghiêm trọng": 4, "Cao": 3, "Trung bình": 2, "Thấp": 1, "Theo dõi": 0}
LEGAL_TOPIC = "Legal & Regulation"
LOCAL_TOPICS = ["Legal & Regulation", "Team & Process"]
KPI_IMPACTS = ["Nghiêm trọng", "Critical", "Cao", "High"]
KPI_NATURES = ["Rủi ro", "Tuân thủ"]
TERMINAL_STATES = ["analyzed", "low_signal", "failed"]

DEFAULT_TOPIC = "DevTools & Frameworks"
TOPIC_REMAP = {
    "Trí tuệ nhân tạo": "AI/ML Ứng dụng", "AI/ML": "AI/ML Ứng dụng", "AI tạo sinh": "AI/ML Ứng dụng", "LLM": "AI/ML Ứng dụng", "Robotics": "AI/ML Nghiên cứu",
    "Phát triển phần mềm": "DevTools & Frameworks", "Công cụ lập trình": "DevTools & Frameworks", "Công nghệ": "DevTools & Frameworks",
    "Đám mây": "Cloud & Infrastructure", "Cloud": "Cloud & Infrastructure", "IoT": "Cloud & Infrastructure", "Viễn thông": "Cloud & Infrastructure",
    "Chip & Hardware": "Cloud & Infrastructure", "Bảo mật": "Security & Compliance", "An ninh mạng": "Security & Compliance", "Dữ liệu lớn": "Data Engineering",
    "Big Data": "Data Engineering", "Dữ liệu": "Data Engineering", "Quy định": "Legal & Regulation", "Pháp lý": "Legal & Regulation",
    "Pháp lý/Tuân thủ": "Legal & Regulation", "Kinh doanh": "Market & Competition", "Startup": "Market & Competition", "Thị trường/Đối thủ": "Market & Competition",
    "Thị trường": "Market & Competition", "Blockchain": "Platform & API", "Dịch vụ/Nền tảng": "Platform & API", "API": "Platform & API",
    "Tự động hóa": "Developer Experience", "DevOps": "Cloud & Infrastructure",
}
EVENT_REMAP = {"Ngừng hỗ trợ": "Ngừng hỗ trợ/Deprecation", "Cập nhật nghiên cứu": "Nghiên cứu/Paper"}
TARGET_ROLES = ["Executive", "Engineering", "Data/AI", "Product", "Content/Marketing", "Legal/Compliance", "HR/L&D", "DevOps", "Infrastructure", "Security", "BA/QA", "Designer/UX", COMPANY_WIDE]
TECHNICAL_ROLES = ["Engineering", "Data/AI", "Security", "DevOps", "Infrastructure", "BA/QA"]

VIETNAMESE_LETTERS = "àáạảãâầấậẩẫăằắặẳẵèéẹẻẽêềếệểễìíịỉĩòóọỏõôồốộổỗơờớợởỡùúụủũưừứựửữỳýỵỷỹđ"
NOT_FOUND = ["không tìm thấy", "không có thông tin", "chưa có tin nào", "không đủ dữ liệu"]
NO_TITLE = "Chưa có tiêu đề"

SALUTATIONS = ["chào", "chao", "hi", "hello", "helo", "hey", "xin", "alo"]
THANKS = ["cảm", "cám", "ơn", "thanks", "thank", "tks", "thankyou", "thanx"]
FILLERS = ["bạn", "bot", "trợ", "lý", "ơi", "nhé", "nha", "nhá", "nhỉ", "vậy", "đấy", "nè", "hen", "ha", "you", "nhiều"]
SELF_WORDS = ["bạn", "bot", "chatbot", "mày", "cậu"]
SELF_PHRASES = ["trợ lý"]
ANAPHORA = ["nó", "này", "kia", "đó", "ấy", "cái", "bài", "tin", "chúng"]
CAPABILITY_PHRASES = [
    "làm được gì", "làm được những gì", "giúp được gì", "giúp được những gì", "giúp gì", "là ai", "chức năng", "khả năng", "công dụng", "hỗ trợ gì",
    "hỗ trợ được gì", "để làm gì", "biết làm gì", "hoạt động thế nào", "hoạt động như thế nào", "giới thiệu",
]
STOPWORDS = [
    "này", "nào", "gì", "có", "không", "cho", "của", "các", "những", "một", "và", "là", "với", "về", "trong", "đến", "tới", "được", "bị", "thì", "mà", "hay",
    "hoặc", "tôi", "mình", "team", "công", "ty", "hệ", "thống", "tin", "tức", "tuần", "nay", "hôm", "vừa", "rồi", "đang", "sẽ", "cần", "nên", "phải",
    "đáng", "chú", "ý", "quan", "tâm", "nhất", "gấp", "mới", "đọc", "xem", "liên", "nói", "ra", "sao", "thế", "làm", "khi", "nếu",
    "ở", "đi", "ta", "họ", "nó", "ai", "ừ", "à", "ạ", "đó", "kia", "ấy", "vì", "do", "tuy", "dù", "chỉ", "cả", "còn", "đã", "vẫn", "cũng",
    "hai", "cái", "bài", "chỗ", "khác", "sánh", "nhau",
]
STATUS_KEYS = ["routing", "searching", "ranking", "reading", "grounding", "web_search", "web_reading", "writing", "checking"]

# Limits.
MIN_CONTENT = 200
MAX_AGE_DAYS = 180
CONTENT_CAP = 8000
MIN_CONFIDENCE = 0.3
LOOKBACK_HOURS = 108
PER_ROLE, PER_DIGEST = 2, 3
COOLDOWN_HOURS = 48
INDEX_TOP, DEEP_SLOTS, PIN_SLOTS = 60, 3, 3
CHUNK_TARGET, CHUNK_MAX, CHUNK_OVERLAP, CHUNK_MIN = 2000, 2400, 300, 120
SIMILARITY, DEDUP_DAYS = 0.6, 7
RRF_K, PASSAGES = 60, 300
