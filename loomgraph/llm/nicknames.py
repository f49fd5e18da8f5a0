"""Short forms of given names in common use."""

from __future__ import annotations

# Short form -> full given names it stands for.
SHORT_FORMS = {
    "abby": ("abigail",), "alex": ("alexander", "alexandra"), "andy": ("andrew",), "ben": ("benjamin",), "beth": ("elizabeth",), "bill": ("william",), "bob": ("robert",),
    "cathy": ("katherine", "catherine"), "charlie": ("charles",), "chris": ("christopher", "christine"), "dan": ("daniel",), "danny": ("daniel",), "dave": ("david",), "drew": ("andrew",),
    "ed": ("edward", "edmund"), "eliza": ("elizabeth",), "fred": ("frederick",), "gabe": ("gabriel",), "greg": ("gregory",), "jim": ("james",), "jo": ("josephine", "joanna"), "joe": ("joseph",),
    "john": ("jonathan",), "jon": ("jonathan",), "josie": ("josephine",), "kate": ("katherine", "catherine"), "kathy": ("katherine",), "katie": ("katherine",), "kit": ("christopher", "katherine"),
    "liz": ("elizabeth",), "lizzie": ("elizabeth",), "matt": ("matthew",), "mike": ("michael",), "nate": ("nathaniel",), "nick": ("nicholas",), "pat": ("patricia", "patrick"), "patty": ("patricia",),
    "pete": ("peter",), "becca": ("rebecca",), "becky": ("rebecca",), "rich": ("richard",), "rick": ("richard",), "rob": ("robert",), "bobby": ("robert",), "sam": ("samuel", "samantha"),
    "steve": ("stephen", "steven"), "sue": ("susan",), "ted": ("theodore", "edward"), "theo": ("theodore",), "tom": ("thomas",), "tommy": ("thomas",), "tony": ("anthony",), "tricia": ("patricia",),
    "vicky": ("victoria",), "tori": ("victoria",), "will": ("william",), "billy": ("william",), "zach": ("zachary",), "ellie": ("eleanor",), "meg": ("margaret",), "peggy": ("margaret",), "maggie": ("margaret",),
    "jack": ("john",), "harry": ("henry",), "larry": ("lawrence",), "jen": ("jennifer",), "jenny": ("jennifer",), "mandy": ("amanda",), "sandy": ("alexandra",), "tina": ("christina",), "toni": ("antonia",),
    "bea": ("beatriz", "beatrice"), "gus": ("august",), "max": ("maximilian",), "nicky": ("nicholas", "nicole"), "ron": ("ronald",), "stan": ("stanley",), "val": ("valerie",), "vic": ("victor",),
    "abi": ("abigail",), "gail": ("abigail",), "alec": ("alexander",), "lex": ("alexander",), "sasha": ("alexander",), "benny": ("benjamin",), "benji": ("benjamin",), "lisa": ("elizabeth",), "betsy": ("elizabeth",),
    "bess": ("elizabeth",), "freddie": ("frederick",), "freddy": ("frederick",), "ant": ("anthony",), "topher": ("christopher",), "robbie": ("robert",), "bert": ("robert",), "sammy": ("samuel",), "teddy": ("theodore",),
    "vicki": ("victoria",), "liam": ("william",), "willy": ("william",), "nico": ("nicholas",), "matty": ("matthew",), "kat": ("katherine",), "bex": ("rebecca",), "trish": ("patricia",), "paddy": ("patricia", "patrick"),
    "jonny": ("jonathan",), "johnny": ("jonathan", "john"), "joey": ("josephine", "joseph"), "fifi": ("fiona",), "gabby": ("gabriel",), "dom": ("dominic",), "manny": ("emmanuel",),
}
