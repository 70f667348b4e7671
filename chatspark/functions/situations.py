"""Situation of a turn: its form, the tags of what it does, a concrete setup, and its social profile.

The rules are data: rows of patterns over the compact text, with what withdraws them. The functions turn the rows into
columns, so a chat's rules can be replaced by giving other tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a pattern is matched with: the whole compact text, or its last line.
TEXT, LAST = "text", "last"

# Fixed values from here to the end of the tables: words, patterns, classes and their order.

#: A last line that is one of these without its marks is an exclamation and nothing else.
EXCLAMATION_MARKS = r"[\s，,。.!！~～…]+"
EXCLAMATIONS = "我操|我擦|卧槽|我靠|擦|艹|草|妈呀|天哪|天呐|啊这|绝了"

#: Forms of a turn; the first that fits.
FORMS = [
    ("choice_question", "(?:还是|或者|或是).{0,18}[?？]$"),
    ("wh_question", "(?:为什么|为啥|怎么|咋|什么|啥|谁|哪|多少|几).{0,24}[?？]?$"),
    ("yes_no_question", "(?:是不是|有没有|能不能|可不可以|要不要|行不行|对不对|吗|么)[?？]?$"),
    ("other_question", "[?？]$"),
]
#: A statement of up to this many letters and digits is brief.
BRIEF = 6

#: Words and patterns of the tags.
VAGUE = "(?:有些|有的|某些|一些)(?:个)?(?:词|话|东西|地方|问题|内容|部分|情况|事)"
UNRESOLVED = "(?:不知道|不清楚|不确定|不会|没想好|不好)(?:该|要)?(?:怎么|如何|咋|翻|说|弄|处理|选|写|回)"
UNCLEAR = [
    "(?:我感觉|我觉得).{0,18}(?:没必要|没有必要|很多(?:种)?(?:办法|方法|解决办法))[啊呀吧。！？]*$",
    "我(?:现在)?跟以前.{0,8}(?:不一样|不同|变了)(?:的)?[啊呀吧。！？]*$",
    "^(?:(?:也)?太坑了?[啊呀吧]*)$",
    "^(?:(?:我)?(?:今天|刚刚|刚才)?刚面(?:完)?的?[啊呀吧]*)$",
]
CALLS = "(?:^|[，,。；;！!？?])(?:在吗|人呢|哪呢|冒个泡)(?:$|[，,。；;！!？?])"
COME_OUT = "(?:^|[，,。；;！!？?])(?:[^，,。；;！!？?]{0,8}[，,])?出来(?:玩|吃|喝|见|聚|pk|冒个泡)?(?:$|[，,。；;！!？?])"
INVITES = ["一起", "来不来", "要不要", "走不走", "帮我", "帮忙", "能不能", "可不可以"]
LEAVING = "我不行(?:了)?[，,。；;！! ]*(?:我)?(?:要|得|先)?(?:去)?(?:睡|休息|躺|撤|走)"
LOWERING = ["我不行", "我太菜", "我真菜", "我废了", "羡慕你们", "羡慕各位", "又亏了", "亏麻了"]
PRAISES = ["牛逼", "厉害", "真强", "太强", "大佬", "优秀", "羡慕", "恭喜", "赚死", "少爷"]
ENVY = ["羡慕你们", "羡慕各位"]
PRAISE_ASKED = "(?:牛逼|厉害|真强|优秀|大佬).{0,3}(?:吗|么)[?？]?$"
COMPLAINTS = ["烦死", "好烦", "累死", "好累", "难受", "疼死", "崩了", "倒霉", "气死", "惨了"]
ON_THE_WAY = ["在路上", "出发了", "下班了", "快到了", "刚到家", "已经到家"]
ARRIVED = "(?:我|你|他|她|我们|你们|他们)(?:刚|已经|快|马上|还没)?到(?:了|家|公司|机场|门口)"
SHARES = ["http://", "https://", "看这个", "这个发你", "发给你", "分享给你", "我分享个"]
TEASES = ["你可真", "就这", "韭菜", "吹牛", "装起来", "复读机", "少装", "别装"]
QUESTIONS = ["?", "？", "为什么", "怎么", "咋", "什么", "啥", "谁", "哪", "多少", "是不是", "有没有"]
#: Names in the interaction's context, and the tags that they stand for.
SKILLS = {"handling_praise": "praise", "handling_vent": "complaint", "answering_questions": "question", "receiving_share": "share"}

#: Setups.
FOLLOW_UP = "(?:那|所以)?你.{0,12}(?:昨天|刚才|前面|之前|上次).{0,18}(?:后来|然后|现在).{0,8}(?:呢|怎么样|咋样|如何)"
WHERE = "(?:人呢|你?在哪(?:里|儿)?|到哪(?:里|儿)?了?|什么位置|发个定位)"
ADDRESSES = [
    r"(?:^|[，,。；;！!？?])(?:我|我们)?(?:已经|刚)?到(?:了|门口).{0,12}(?:是|对不对|没错吧).{0,10}(?:吗|吧|[?？])",
    r"(?:地址|房间|楼栋|门牌).{0,10}(?:对|是|没错).{0,4}(?:吗|吧|[?？])",
    r"(?:是|在|到)(?:几号楼|几楼|几室|\d+号楼|\d+楼|\d+室|\d+号门)(?:吗|吧|[?？])",
    r"(?:几号楼|几楼|几室|哪个楼|哪栋|哪个房间)(?:吗|呢|吧|[?？])",
]
REQUESTS = [
    "(?:帮我|帮忙|麻烦你|替我|给我).{0,16}(?:拿|取|带|买|改|看|发|问|弄|处理|接|送|查)",
    "(?:能不能|可不可以|可以不可以).{0,6}(?:帮|替|给).{0,16}(?:拿|取|带|买|改|看|发|问|弄|处理|接|送|查)",
]
JOINING = ["一起", "来不来", "要不要", "走不走"]
MEETING = "出来(?:吃|喝|玩|见|聚)"
FAVOURS = "(?:帮我|帮忙|麻烦你|替我|给我)"
PLAYFUL = "(?:你可真|你又|你还|就你|少装|别装|真能吹|会吹|装起来)"

#: Profile: whom praise means, how the speaker stands, and which answer is expected.
LISTENERS = ["你们", "各位", "大家"]
LISTENER = ["(?:^|[，,。；;！!？?])你[^，,。；;！!？?]{0,12}(?:牛逼|厉害|真强|太强|大佬|优秀)", "(?:羡慕|恭喜)[^，,。；;！!？?]{0,6}你"]
THIRD_PARTY = "(?:他|她|他们|她们|这人|那人)[^，,。；;！!？?]{0,12}(?:牛逼|厉害|真强|太强|大佬|优秀)"
SELF_LOWERING = ["我不行", "我太菜", "我真菜", "我不配", "我这种穷", "穷逼", "特别痛苦"]
HEARSAY = [
    "(?:听|据|传|消息|线人|内部|hr|朋友|同学|亲戚|叔叔|阿姨)[^，,。；;！!？?]{0,16}(?:说|称|透露|告诉|爆料)",
    "(?:人品|性格|能力|水平|技术|表现)[^，,。；;！!？?]{0,8}(?:好|差|强|弱|靠谱|优秀|不行)",
    "(?:同学|朋友|熟人|亲戚)[^，,。；;！!？?]{0,18}(?:来看看|看一下|报价|问问)",
]
CODE = r"^(?:[a-z]*\d+[a-z\d]*|\d+[a-z]+)$"
#: A turn after lines of this many characters, itself up to that many long, goes on with them.
EARLIER_CHARS, LAST_CHARS = 30, 8


@dataclass(frozen=True)
class Rule:
    """`name` holds where every one of `all_of` has a pattern that fits, and none of `unless` fits."""

    name: str
    all_of: tuple[tuple[str, list[str]], ...]
    unless: tuple[tuple[str, list[str]], ...] = ()
    fresh: bool = False  # doesn't hold for a short turn that goes on with earlier lines


def literal(words: list[str]) -> list[str]:
    """Patterns of words as they stand."""
    return ["".join(f"\\{c}" if c in r".?*+|()[]{}^$\\" else c for c in w) for w in words]


def rule(name: str, patterns: list[str], on: str = TEXT, unless: list[str] | None = None, fresh: bool = False) -> Rule:
    return Rule(name, ((on, patterns),), ((TEXT, unless),) if unless else (), fresh)


TAGS = [
    Rule("needs_clarification", ((TEXT, [VAGUE]), (TEXT, [UNRESOLVED]))), rule("needs_clarification", UNCLEAR),
    rule("calling_presence", [CALLS], on=LAST, fresh=True), rule("calling_presence", [COME_OUT]),
    rule("invitation_request", literal(INVITES)), rule("self_deprecation", literal(LOWERING), unless=[LEAVING]),
    rule("praise", literal(PRAISES), unless=[PRAISE_ASKED]), rule("complaint", literal(COMPLAINTS)),
    rule("arrival_status", [*literal(ON_THE_WAY), ARRIVED]), rule("share", literal(SHARES)), rule("teasing", literal(TEASES)), rule("question", literal(QUESTIONS)),
]
#: A tag that another takes away where a pattern fits.
WITHDRAWN = [("praise", "self_deprecation", literal(ENVY))]
SETUPS = [
    rule("thread_followup", [FOLLOW_UP]), rule("location_followup", [WHERE]), rule("address_confirmation", ADDRESSES), rule("task_request", REQUESTS),
    rule("invitation", [*literal(JOINING), MEETING], unless=[FAVOURS]), rule("playful_teasing", [PLAYFUL]), rule("emotion_vent", literal(COMPLAINTS)),
]
TARGETS = [rule("listener_group", literal(LISTENERS)), rule("listener", LISTENER), rule("third_party", [THIRD_PARTY])]
#: Expected answers by tag, or by the target of praise and the posture; the first that holds.
MOVES = [
    ({"tag": "brief_exclamation"}, "instant_reaction"), ({"tag": "needs_clarification"}, "clarify_detail"), ({"tag": "calling_presence"}, "brief_presence"),
    ({"tag": "invitation_request"}, "accept_decline_or_clarify"), ({"tag": "teasing"}, "playful_counter"), ({"tag": "complaint"}, "acknowledge_or_share_feeling"),
    ({"target": ["listener", "listener_group"], "posture": "self_lowering"}, "downplay_or_counter_praise"), ({"target": ["listener", "listener_group"]}, "deflect_or_playfully_accept"),
    ({"target": ["third_party"]}, "agree_or_comment"), ({"tag": "self_deprecation"}, "acknowledge_or_reassure"), ({"tag": "question"}, "direct_answer"), ({"tag": "share"}, "acknowledge_share"),
]

# End of the fixed values.


def compact(text: Column) -> Column:
    """Lower case without white space."""
    return F.regexp_replace(F.lower(text), r"(?U)\s+", "")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\\R"), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")


class _Turn:
    """The columns that rules look at."""

    def __init__(self, text: Column):
        lines = _lines(text)
        self.text = compact(text)
        self.last = F.when(F.size(lines) > 0, compact(F.element_at(lines, -1))).otherwise(self.text)
        earlier = F.length(F.array_join(F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0))), ""))
        self.goes_on = (F.size(lines) > 1) & (earlier >= EARLIER_CHARS) & (F.length(self.last) <= LAST_CHARS)
        self.exclaims = _exclaims(self.last)

    def any(self, on: str, patterns: list[str]) -> Column:
        return getattr(self, on).rlike("|".join(patterns))

    def holds(self, r: Rule) -> Column:
        out = reduce(and_, [self.any(*x) for x in r.all_of])
        for x in r.unless:
            out = out & ~self.any(*x)
        return out & ~self.goes_on if r.fresh else out


def _exclaims(line: Column) -> Column:
    return F.regexp_replace(line, EXCLAMATION_MARKS, "").rlike(f"^(?:{EXCLAMATIONS})$")


def turn_form(text: Column) -> Column:
    """How a turn asks or tells: exclamation, choice, wh, yes/no or other question, brief statement or statement; empty for none."""
    c = compact(text)
    out = F.when(c == "", "").when(_exclaims(c), "brief_exclamation")
    for name, pattern in FORMS:
        out = out.when(c.rlike(pattern), name)
    return out.when(F.length(F.regexp_replace(c, "[^0-9a-z一-鿿]+", "")) <= BRIEF, "brief_statement").otherwise("statement")


def situation_tags(text: Column, context: Column | None = None) -> Column:
    """The tags of a turn in name order; `context` may name skills that stand for tags."""
    turn = _Turn(text)
    found: dict[str, Column] = {}
    for r in TAGS:
        holds = turn.holds(r)
        found[r.name] = found[r.name] | holds if r.name in found else holds
    for tag, by, patterns in WITHDRAWN:
        found[tag] = found[tag] & ~(found[by] & turn.any(TEXT, patterns))
    if context is not None:
        for skill, tag in SKILLS.items():
            found[tag] = found[tag] | F.coalesce(F.contains(context, F.lit(skill)), F.lit(False))
    tags = F.array_compact(F.array(*[F.when(c, F.lit(t)) for t, c in sorted(found.items())]))
    return F.when(turn.exclaims, F.array(F.lit("brief_exclamation"))).otherwise(tags)


def precise_situation(text: Column) -> Column:
    """The first setup that the wording makes sure, else empty."""
    turn = _Turn(text)
    return F.coalesce(*[F.when(turn.holds(r), r.name) for r in SETUPS], F.lit(""))


def information_gap(text: Column) -> Column:
    """Whether a turn tells what others say or think, or ends in a code that nothing explains."""
    turn = _Turn(text)
    return turn.any(TEXT, HEARSAY) | turn.any(LAST, [CODE])


def situation_profile(text: Column, context: Column | None = None, ask_for_detail: bool = False) -> Column:
    """praise_target, speaker_posture and expected_move of a turn, each null where it has none.

    With `ask_for_detail` a turn with an information gap expects to be asked about it.
    """
    turn, tags = _Turn(text), situation_tags(text, context)
    has = lambda t: F.array_contains(tags, t)
    praising = has("praise") | has("self_deprecation")
    target = F.when(praising, F.coalesce(*[F.when(turn.holds(r), r.name) for r in TARGETS]))
    posture = F.when(praising & (has("self_deprecation") | turn.any(TEXT, literal(SELF_LOWERING))), "self_lowering")
    moves = [F.when(information_gap(text), "verify_or_request_detail")] if ask_for_detail else []
    for when, move in MOVES:
        parts = [has(when["tag"])] if "tag" in when else [target.isin(when["target"])]
        if "posture" in when:
            parts.append(posture == when["posture"])
        moves.append(F.when(reduce(and_, parts), move))
    return F.struct(target.alias("praise_target"), posture.alias("speaker_posture"), F.coalesce(*moves).alias("expected_move"))

