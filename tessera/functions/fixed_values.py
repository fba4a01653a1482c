"""Fixed values that must equal the reference behaviour for right results.

They are stated here plainly, in their natural order, and passed to the
operators as default arguments; callers may supply their own lists.
"""

# --- FIXED VALUES: filler tokens removed by the document cleaner -----------
FILLER_WORDS = [
    "呃", "嗯", "啊", "哎", "额", "那个", "这个", "然后", "就是",
    "比如说", "怎么说呢", "对不对", "你知道吗", "是吧", "对吧",
]

# --- FIXED VALUES: chunk separators, tried in this order ---------------------
SEPARATORS = ["\n\n", "\n", "。", "！", "？", "；", "，", " ", ""]

# --- FIXED VALUES: chunking defaults -----------------------------------------
CHUNK_SIZE = 1000
CHUNK_OVERLAP = 200
TIME_MATCH_PREFIX = 50  # characters of a chunk used to locate it in the text

# --- FIXED VALUES: ASCII marks turned into full-width marks ------------------
# Each mark also swallows one following space.
ASCII_MARKS = ",.?!:;"
FULL_WIDTH_MARKS = "，。？！：；"

# --- FIXED VALUES: marks whose same-mark runs collapse to one ----------------
DEDUP_MARKS = "。！？，；："

# --- FIXED VALUES: marks whose mixed runs collapse in segment cleaning -------
SEGMENT_DEDUP_MARKS = "。，"

# --- FIXED VALUES: URL lists ----------------------------------------------------
# Substrings of the lower-cased URL accepted by the loose domain check; the
# same list is matched against the lower-cased host by the strict check.
ALLOWED_DOMAINS = [
    "bilibili.com",
    "www.bilibili.com",
    "b23.tv",
    "m.bilibili.com",
    "youtube.com",
    "www.youtube.com",
    "youtu.be",
    "m.youtube.com",
]
CHANNEL_PATTERNS = ["/channel/", "/c/", "/@", "/user/", "space.bilibili.com/"]
PLAYLIST_PATTERNS = ["list=", "/playlist?"]
# Case-sensitive markers that make a channel URL get a "/videos" listing suffix.
CHANNEL_LISTING_MARKERS = ["/channel/", "/@", "/user/"]
ITEM_URL_PREFIX = "https://www.youtube.com/watch?v="
PLAYLIST_URL_PREFIX = "https://www.youtube.com/playlist?list="
DEFAULT_CHANNEL_LIMIT = 10

# --- FIXED VALUES: search defaults -----------------------------------------------
DEFAULT_TOP_K = 5
DEFAULT_COLLECTION = "bili_videos"
DEMO_QUERY = "视频内容"
REPORT_PREVIEW = 300       # characters of chunk text in a search report
DEMO_PREVIEW = 200         # characters of chunk text in the demo report

# --- FIXED VALUES: labels of a search report ---------------------------------------
REPORT_RESULT = "--- Result "
REPORT_SCORE = " (Score: "
REPORT_END = ") ---"
REPORT_TEXT = "Text: "
REPORT_TIME = "Time: "
REPORT_SOURCE = "Source: "

# --- FIXED VALUES: metadata keys flattened into stored rows and stripped on read
FLATTENED_KEYS = ["start_time", "end_time", "source_file", "chunk_index",
                  "model_name", "dimension"]

# --- FIXED VALUES: transcript document labels ------------------------------------
MD_TITLE = "# 转录结果"
MD_LANGUAGE = "语言"
MD_SOURCE = "来源"
MD_FULL_TEXT = "## 完整文本"
MD_SEGMENTS = "## 时间戳段落"

# --- FIXED VALUES: traditional -> simplified character pairs (96 pairs) ------
TRADITIONAL_TO_SIMPLIFIED = [
    ("這", "这"), ("個", "个"), ("來", "来"), ("過", "过"), ("時", "时"), ("間", "间"),
    ("問", "问"), ("題", "题"), ("還", "还"), ("會", "会"), ("後", "后"), ("現", "现"),
    ("開", "开"), ("關", "关"), ("長", "长"), ("說", "说"), ("見", "见"), ("聽", "听"),
    ("買", "买"), ("賣", "卖"), ("錢", "钱"), ("業", "业"), ("專", "专"), ("學", "学"),
    ("經", "经"), ("營", "营"), ("場", "场"), ("機", "机"), ("種", "种"), ("類", "类"),
    ("計", "计"), ("劃", "划"), ("進", "进"), ("選", "选"), ("擇", "择"), ("決", "决"),
    ("確", "确"), ("實", "实"), ("際", "际"), ("況", "况"), ("標", "标"), ("準", "准"),
    ("語", "语"), ("詞", "词"), ("資", "资"), ("產", "产"), ("應", "应"), ("該", "该"),
    ("無", "无"), ("沒", "没"), ("離", "离"), ("達", "达"), ("連", "连"), ("運", "运"),
    ("轉", "转"), ("變", "变"), ("網", "网"), ("頭", "头"), ("臉", "脸"), ("導", "导"),
    ("師", "师"), ("領", "领"), ("創", "创"), ("負", "负"), ("責", "责"), ("課", "课"),
    ("測", "测"), ("試", "试"), ("驗", "验"), ("證", "证"), ("識", "识"), ("認", "认"),
    ("為", "为"), ("處", "处"), ("給", "给"), ("讓", "让"), ("帶", "带"), ("從", "从"),
    ("將", "将"), ("於", "于"), ("與", "与"), ("對", "对"), ("幾", "几"), ("樣", "样"),
    ("麼", "么"), ("車", "车"), ("軟", "软"), ("體", "体"), ("係", "系"), ("統", "统"),
    ("電", "电"), ("腦", "脑"), ("視", "视"), ("頻", "频"), ("聲", "声"), ("響", "响"),
]

TRADITIONAL_CHARS = "".join(t for t, _ in TRADITIONAL_TO_SIMPLIFIED)
SIMPLIFIED_CHARS = "".join(s for _, s in TRADITIONAL_TO_SIMPLIFIED)
