"""Fixed values that results depend on."""

# Placeholder for an unknown category, title or summary.
UNKNOWN = "未知"
UNKNOWN_TITLE = "未知标题"
UNKNOWN_ORIGINAL_TITLE = "Unknown Title"
UNKNOWN_ORIGINAL_TITLE_SHORT = "Unknown"
NO_SUMMARY = "无简介"

# Score used when a column has no mean.
DEFAULT_SCORE = 6.0

# First year a title can have, and the year that stands for "unknown".
FIRST_YEAR = 1888
UNKNOWN_YEAR = 0

# Characters the word count turns into spaces: ASCII and CJK punctuation and the newline.
PUNCTUATION = ".,!?;:\"'()[]{}，。！？；：（）《》【】—…·、\n"

# Whitespace of a regular expression's \s, and whitespace as str.split() sees it.
ASCII_SPACES = "\t\n\x0b\x0c\r "
ALL_SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# Popularity classes by number of votes and quality classes by score; highest bound first.
POPULARITY = [(1_000_000, "超热门(≥100万)"), (500_000, "热门(≥50万)"), (100_000, "中等(≥10万)")]
POPULARITY_REST = "冷门(<10万)"
QUALITY = [(9.0, "神作(≥9.0)"), (8.0, "佳作(≥8.0)"), (7.0, "良好(≥7.0)")]
QUALITY_REST = "一般(<7.0)"

ABOVE_AVERAGE = "Above Avg"
BELOW_AVERAGE = "Below Avg"

# Topics of the telemetry feed.
TOPIC_TEMPERATURE = "sensors/temperature"
TOPIC_HUMIDITY = "sensors/humidity"
TOPIC_STATUS = "sensors/status"
TOPICS = [TOPIC_TEMPERATURE, TOPIC_HUMIDITY, TOPIC_STATUS]
UNKNOWN_DEVICE = "unknown"
