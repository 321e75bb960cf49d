"""A small table of labelled URLs for the URL filter: 1 is wanted, 0 is not. Sites are of general kinds; none is taken from a corpus."""

_TOPICS = """news-daily weather-report city-library museum-guide school-board science-today garden-club music-review recipe-box travel-notes history-forum reference-docs open-wiki
book-shop health-advice sports-results street-maps theatre-season village-bakery harbor-watch river-trust mountain-hut orchard teachers-room student-union journal gazette tribune herald observer physics-notes chemistry-lab
biology-class algebra-help poetry-corner painters gallery stone-bridge kitchen-table market-hall railway-station network-status weblog photo-album cinema-club dance-school yoga-studio cycling-tours hiking-paths camping-gear airport-info hostel-guide
town-council parish-records charity-fund clinic-hours dentist lawyer notary accountant insurance-desk housing-office atelier workshop bank-holidays free-software best-practice win-win-dialogue fast-trains link-library
adelaide-post betterment click-here-not tracking-birds farmers-weekly pillow-makers essex-times scunthorpe-echo cheddar-cheese lotteria-cafe""".split()
_SYLLABLES = "ba be bi bo bu ca ce co da de di do du fa fe fi fo ga ge gi go ha he hi ho ja jo ka ke ki ko la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo wa we za ze zo".split()
_ENDS = ("n", "r", "s", "l", "th", "nd", "st", "ing", "tion", "ble", "ent", "ou", "ea", "sh", "")
_PAIRS = {
    "adult": "cam video tube girls dates films".split(), "xxx": "tube films dates cams".split(), "porn": "hub-clips hd best daily".split(), "sexy": "girls cams chat dates".split(), "escort": "girls-now service book".split(),
    "casino": "royal big online spins gold live".split(), "win": "jackpots lottery slots cash big".split(), "bets": "online now best sports live".split(), "free": "spins porn keygen money slots casino pills".split(), "poker": "win rooms cash".split(), "slots": "gold king win".split(),
    "spam": "links click mail seo net".split(), "link": "farms exchange spam seller".split(), "farm": "links clicks seo traffic".split(), "seo": "spam boost links".split(),
    "cheap": "viagra meds cialis rolex loans".split(), "pills": "online buy discount diet shop store".split(), "viagra": "shop buy generic".split(), "meds": "no-script discount".split(), "buy": "followers pills-now xanax".split(),
    "ads": "pixel server banner popup click network".split(), "ad": "tracker server clicks delivery".split(), "track": "click pixel users clicks popunder".split(), "tracker": "ads pixel".split(), "click": "tracks ads bait bonus".split(),
    "payday": "loans cash".split(), "loan": "fast shark instant".split(), "warez": "crack download".split(), "crack": "serial keys".split(), "torrent": "warez movies-free".split(), "crypto": "scam doubler giveaway".split(), "replica": "watches bags".split(), "miracle": "diet cure".split(),
}
_PREFIX = ("", "www.", "m.", "blog.")
_SUFFIX = ("example.com", "example.net", "example.org")
_PATHS = ("/en/{n}", "/de/{n}/", "/fr/{n}.html", "/es/{n}?page=2&ref=x", "/en/{n}#top", "/{n}?utm_source=feed", "/article/{n}", "/")


def _spoken(i: int) -> str:
    """An invented name of two or three syllables."""
    k, out = i * 7919 + 12345, ""
    for _ in range(2 + i % 2):
        out += _SYLLABLES[k % len(_SYLLABLES)]
        k //= 7
    return out + _ENDS[i % len(_ENDS)]


GOOD = [*_TOPICS, *(_spoken(i) for i in range(160))]
BAD = [f"{a}-{b}" for a, own in _PAIRS.items() for b in own]
LABELLED: list[tuple[str, int]] = [
    (f"http{'s' * ((i + j) % 2)}://{_PREFIX[(i + j) % 4]}{site}.{_SUFFIX[(i + 2 * j) % 3]}" + _PATHS[(i + 3 * j) % 8].format(n=37 * i + 11 * j), label)
    for label, sites in ((1, GOOD), (0, BAD))
    for i, site in enumerate(sites)
    for j in range(3)
]
