"""Fixed values that results depend on: word lists, character classes, patterns, columns."""

# The 32 ASCII punctuation marks.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""

# Every character str.strip() treats as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002"
    "\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)

# The pattern of tokens that hold a handle, a hashtag or a web address. The class
# of the handle really reads "0-a9", which also spans : ; < = > ? @ [ \ ] ^ and the backtick; it
# only decides whether a token is dropped. White space is written out, since it has to be Unicode's
# both in Java and in SQL engines, whose \s is ASCII's.
WEB_TOKEN = rf"""(@[A-Za-z0-a9_]+)|(#[A-Za-z0-9_]+)|(https?://[^{WHITESPACE}<>"]+|www\.[^{WHITESPACE}<>"]+)"""

# The code points with the Unicode property Emoji, without the digits, #, *
# and the regional indicators, which are emoji only in sequences.
EMOJI_RANGES = """
A9 AE 203C 2049 2122 2139 2194-2199 21A9-21AA 231A-231B 2328 23CF 23E9-23F3 23F8-23FA 24C2
25AA-25AB 25B6 25C0 25FB-25FE 2600-2604 260E 2611 2614-2615 2618 261D 2620 2622-2623 2626 262A
262E-262F 2638-263A 2640 2642 2648-2653 265F-2660 2663 2665-2666 2668 267B 267E-267F 2692-2697
2699 269B-269C 26A0-26A1 26A7 26AA-26AB 26B0-26B1 26BD-26BE 26C4-26C5 26C8 26CE-26CF 26D1
26D3-26D4 26E9-26EA 26F0-26F5 26F7-26FA 26FD 2702 2705 2708-270D 270F 2712 2714 2716 271D 2721
2728 2733-2734 2744 2747 274C 274E 2753-2755 2757 2763-2764 2795-2797 27A1 27B0 27BF 2934-2935
2B05-2B07 2B1B-2B1C 2B50 2B55 3030 303D 3297 3299 1F004 1F0CF 1F170-1F171 1F17E-1F17F 1F18E
1F191-1F19A 1F201-1F202 1F21A 1F22F 1F232-1F23A 1F250-1F251 1F300-1F321 1F324-1F393 1F396-1F397
1F399-1F39B 1F39E-1F3F0 1F3F3-1F3F5 1F3F7-1F4FD 1F4FF-1F53D 1F549-1F54E 1F550-1F567 1F56F-1F570
1F573-1F57A 1F587 1F58A-1F58D 1F590 1F595-1F596 1F5A4-1F5A5 1F5A8 1F5B1-1F5B2 1F5BC 1F5C2-1F5C4
1F5D1-1F5D3 1F5DC-1F5DE 1F5E1 1F5E3 1F5E8 1F5EF 1F5F3 1F5FA-1F64F 1F680-1F6C5 1F6CB-1F6D2
1F6D5-1F6D9 1F6DC-1F6E5 1F6E9 1F6EB-1F6EC 1F6F0 1F6F3-1F6FC 1F7E0-1F7EB 1F7F0 1F90C-1F93A
1F93C-1F945 1F947-1F9FF 1FA70-1FA7C 1FA80-1FAC6 1FAC8 1FACC-1FADD 1FADF-1FAEB 1FAEF-1FAFA
""".split()

# Spark's English stop words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing a an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very s
t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd
they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't
weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't
couldn't cannot could here's how's let's ought that's there's what's when's where's who's why's
would
""".split()

def _character_class(ranges):
    spans = (r.split("-") for r in ranges)
    return "[" + "".join("-".join(f"\\x{{{c}}}" for c in span) for span in spans) + "]"


_BASE = _character_class(EMOJI_RANGES)
_STYLED = _BASE + r"[\x{FE0F}\x{1F3FB}-\x{1F3FF}]*"
# The few wide spans that hold all base characters and flags.
_SPANS = r"[\x{A9}\x{AE}\x{203C}-\x{2BFF}\x{3030}\x{303D}\x{3297}\x{3299}\x{1F004}-\x{1FAFA}]"


def emoji_pattern(guard: str = "") -> str:
    """One whole emoji: keycap, flag, or base characters with their variation selectors,
    skin tones and tags, joined by zero-width joiners."""
    tags = r"(?:[\x{E0020}-\x{E007E}]+\x{E007F})?"
    joined = _STYLED + tags + r"(?:\x{200D}" + _STYLED + ")*"
    return r"[#*0-9]\x{FE0F}?\x{20E3}|" + guard + r"(?:[\x{1F1E6}-\x{1F1FF}]{2}|" + joined + ")"


def emoji_character_pattern(guard: str = "") -> str:
    """Any single character that marks its token as holding an emoji."""
    return guard + _BASE[:-1] + r"\x{1F1E6}-\x{1F1FF}]"


# Java tests a class of many ranges one by one; looking ahead for the wide spans first spares
# that for nearly every character.
EMOJI = emoji_pattern(guard=f"(?={_SPANS})")
EMOJI_CHARACTER = emoji_character_pattern(guard=f"(?={_SPANS})")
