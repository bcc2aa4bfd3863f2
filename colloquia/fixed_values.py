"""Lists, patterns and limits that results depend on, as plain text.

Patterns are written for Java regular expressions (Spark); they hold no logic.
"""

# --- fixed values: text cleaning ---
JS_SPACE = r"[\s\x0B\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
SPACE_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LIGHT_CONTROL = r"[\uFFFD\x00-\x08\x0B-\x1F\x7F]"
ANSWER_CONTROL = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F\uFFFD]"
SNIPPET_NOISE = r"[\uFFFD\x00-\x1F\x7F-\xA0]"
SNIPPET_SEGMENT = r"([\u4E00-\u9FFF]{2,}[，。！？、：；]?|[A-Za-z][A-Za-z'-]{2,}|[0-9]{2,})"
BODY_KEEP = r"[^\p{L}\p{N}\p{P}\p{S}\s._:/\\-]+"
PATH_KEEP = r"[^\p{L}\p{N}\p{P}\p{S}\s._:\\-]+"
URL = r"""(https?://[^\s<>"'）)]+)"""
LIKELY_TOKEN = r"""([a-fA-F0-9]{32}|[A-Za-z]:\\[^\x00-\x1f"'<>|]+|[A-Za-z0-9_.-]+\.(?:jpg|jpeg|png|gif|webp|mp4|mov|avi|mkv))"""
LOCAL_STAMP = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}(?::\d{2})?)"

# --- fixed values: tokens ---
HAN_TOKEN = r"(\p{IsHan}{2,8})"
LATIN_TOKEN = r"([a-zA-Z][a-zA-Z0-9_-]{2,}|[0-9]{3,})"
STOP_WORDS = [
    "这个", "那个", "什么", "怎么", "可以", "可能", "还是", "就是", "不是", "没有", "已经", "现在", "今天", "昨天",
    "明天", "一下", "一个", "直接", "然后", "应该", "感觉", "看看", "哈哈", "的话", "是不是", "为什么", "有人", "大家",
    "我们", "你们", "他们", "自己", "这里", "那里", "问题", "东西", "消息", "群里",
    "the", "and", "for", "with", "that", "this", "from", "http", "https", "com",
]

# --- fixed values: signals ---
ACTION_WORDS = ["请", "麻烦", "需要", "能否", "能不能", "帮我", "帮忙", "谁能", "处理", "确认", "回复", "看看", "解决", "安排", "发一下", "给一下"]
RISK_WORDS = ["报错", "错误", "失败", "不能用", "异常", "投诉", "退款", "封号", "丢失", "泄露", "风险", "报警", "崩", "挂", "卡死", "超时",
              "timeout", "404", "403", "401", "429"]

# --- fixed values: asks ---
SHORT_ASK = r"^(?i:kk)([tokypTOKYP])(?![A-Za-z0-9_])"
SHORT_ASK_INTENT = {"t": "prompt", "o": "original", "y": "original", "p": "prompt"}
ASK_MEANING = "是什么|什么意思|啥意思"
EXACT_ASKS = [
    (r"^原图[呢吗？?！!。，,\s]*$", "original"),
    (r"^康康[呀吧？?！!。，,\s]*$", "prompt"),
    (r"(?i)^(?:求|要|想看|讨|跪求)(?:一?[下个]?)?(?:tag|prompt|提示词|咒语?|参数)[呀吧？?！!。，,\s]*$", "prompt"),
    (r"^(?:求|要|想看|讨|跪求)(?:一?[下个]?)?原图[呀吧？?！!。，,\s]*$", "original"),
    (r"(?i)^(?:看看|康康|发个?|出个?|来个?)(?:tag|prompt|提示词|咒语?|工作流)[呀吧？?！!。，,\s]*$", "prompt"),
    (r"^(?:看看|康康)原图[呀吧？?！!。，,\s]*$", "original"),
]
CONTEXTUAL_ASKS = [
    (r"(?:^|[\s，,])(?:发|给|甩|扔)(?:我|来|过来)(?:一?[下个张]?)?\s*原图", "original"),
    (r"原图\s*(?:发|给|甩|扔)(?:我|来|过来)", "original"),
    (r"(?i)(?:tag|prompt|提示词|咒语?|工作流|参数)\s*(?:发|给|甩)(?:我|来|过来)(?:康康|看看)?", "prompt"),
    (r"(?i)(?:求|讨|跪求)(?:一?[下个]?)\s*(?:tag|prompt|提示词|咒语?|工作流)", "prompt"),
]
NOT_AN_ASK = [
    "是什么|什么意思|啥意思",
    "比你|比我|还清晰|还好|就是|不是|没有|我没|应该|可能|因为|已经|之前|好像",
    "给我爆回去|我发过|我传过|我保留",
]
EXACT_ASK_CHARS, CONTEXTUAL_ASK_CHARS = 12, 30

# --- fixed values: prompt-shaped answers ---
PARAMETER_MARKERS = r"(?i)(?:Negative prompt:|Steps:\s*\d+|Sampler:|CFG scale:|Model hash:)"
PROMPT_VOCABULARY = [
    r"(?i)(?<![A-Za-z0-9_])(?:masterpiece|best quality|amazing quality|absurdres|highres|lowres|very aesthetic)(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])(?:worst quality|low quality|normal quality|jpeg artifacts|bad anatomy|extra digits)(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])\d?(?:girl|boy)s?(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])(?:solo|looking at viewer|full body|upper body|cowboy shot|portrait)(?![A-Za-z0-9_])",
    r"(?i)<lora:[^>]+>",
    r"(?i)(?<![A-Za-z0-9_])(?:score_\d|source_anime|rating:\s*\w+)(?![A-Za-z0-9_])",
    r"(?i)(?<![A-Za-z0-9_])(?:artist:(?=[A-Za-z0-9_])|year 20\d\d(?![A-Za-z0-9_]))",
    r"(?i)(?:^|[,，])\s*(?:1girl|1boy|2girls)(?![A-Za-z0-9_])",
]
# words of which a text matching the markers or the vocabulary must hold at least one
PROMPT_HINTS = ["prompt:", "steps:", "sampler:", "scale:", "hash:", "masterpiece", "quality", "absurdres", "highres", "lowres", "aesthetic", "artifacts", "anatomy",
                "digits", "girl", "boy", "solo", "viewer", "body", "shot", "portrait", "<lora:", "score_", "source_anime", "rating:", "artist:", "year 20"]
MIN_VOCABULARY_HITS, MIN_PROMPT_SEGMENTS, MIN_PROMPT_CHARS, MAX_SEGMENT_CHARS = 2, 4, 24, 40
PROSE_MARK, PROSE_HAN_SHARE = "[。！？!?；]", 0.3
ANSWER_WINDOW, ORIGINAL_ANSWER_WINDOW, AUTHOR_WINDOW, GUESS_WINDOW = 1800, 120, 1800, 120

# --- fixed values: media ---
IMAGE_EXTENSIONS = ["jpeg", "jpg", "png", "gif", "webp", "bmp", "jfif", "heic"]
VIDEO_EXTENSIONS = ["mp4", "mov", "avi", "mkv", "webm"]
AUDIO_EXTENSIONS = ["amr", "silk", "m4a", "wav", "mp3"]
DOC_EXTENSIONS = ["pdf", "zip", "7z", "rar", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "txt", "apk"]
WEB_IMAGES = ["jpg", "jpeg", "png", "gif", "webp", "bmp", "avif"]
WEB_VIDEOS = ["mp4", "webm", "mov", "m4v", "ogg"]
KIND_LABELS = {"image": "图片", "video": "视频", "audio": "语音", "emoji": "表情", "file": "文件"}
REVIEW_STATUSES = ["unreviewed", "reviewed", "follow-up"]

# --- fixed values: generation parameters ---
PARAM_LINE = r"(?:^|,\s*)(?:Steps|Sampler|CFG scale|Seed|Size|Model hash|Schedule type):\s"
PARAM_NAMES = {
    "steps": "steps", "sampler": "sampler", "schedule type": "scheduler", "cfg scale": "cfgScale", "seed": "seed",
    "size": "size", "model hash": "modelHash", "model": "model", "denoising strength": "denoisingStrength",
    "clip skip": "clipSkip", "version": "version", "lora hashes": "loraHashes", "hires upscaler": "hiresUpscaler",
    "hires steps": "hiresSteps", "vae": "vae", "module 1": "vae",
}
INT_PARAMS = ["steps", "clipSkip", "hiresSteps"]
FLOAT_PARAMS = ["cfgScale", "denoisingStrength"]
LORA_PLACEHOLDERS = ["none", "null", "undefined", "", "无", "不使用"]
COMMENT_PARAMS = {"steps": "steps", "sampler": "sampler", "scale": "cfgScale", "seed": "seed", "noise_schedule": "scheduler", "strength": "denoisingStrength"}
MAX_PROMPT_CHARS, MAX_CHUNK_CHARS, MAX_GRAPH_NODES, MAX_LINK_DEPTH = 20000, 60000, 4000, 16
TEXT_INPUTS = ["text", "value", "positive", "text_0", "prompt", "text_g", "text_l", "string", "populated_text", "wildcard_text"]
LINK_INPUTS_FIRST = ["text", "conditioning", "positive", "negative"]
CHECKPOINT_INPUTS = ["ckpt_name", "unet_name", "model_path"]
LORA_NAME_KEYS = ["lora_name", "lora", "name", "loraName"]
LORA_WEIGHT_KEYS = ["strength_model", "lora_weight", "strength", "weight"]
OUTPUT_NAME = r"(?i)^ComfyUI[_\d]*\.?|^\d+_?\."
WIDGET_NAME = r"(?i)\.(?:safetensors|ckpt|pt|sft|gguf)$"
PLACEHOLDER_GENERATOR = "stripped"

# --- fixed values: names and export ---
RESERVED_NAMES = ["con", "prn", "aux", "nul"] + [f"{p}{i}" for p in ("com", "lpt") for i in range(1, 10)]
CSV_COLUMNS = ["hash", "imageFile", "promptFile", "generator", "promptSource", "checkpoint", "loras", "width", "height",
               "sender", "groupName", "sentAt", "prompt", "negativePrompt"]
BYTE_UNITS = ["B", "KB", "MB", "GB", "TB"]
IMPORTANCE = ["high", "medium", "low"]
MISC_TOPIC, MEDIA_TOPIC, TOPIC_PREFIX, UNNAMED_TOPIC = "未归类 / 零散消息", "媒体消息", "关于 ", "动态主题"
