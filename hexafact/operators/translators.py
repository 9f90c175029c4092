"""Built-in translators: source tables to facts and hub rows, by expressions alone.

A translator takes a table and a lens id and returns the identity of a row
(null: the row is skipped), the facts and the hub rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


from hexafact.functions import scalars as S
from hexafact.operators.compile import fact, facts_from_array, spoke

Translator = Callable[[DataFrame, str], tuple[Column, DataFrame, DataFrame]]

# Codes in the format column of a record collection.
FORMATS = ("LP", "2xLP", "3xLP", "4xLP", "5xLP", "6xLP", '7"', '10"', '12"', "CD", "2xCD", "3xCD", "Cass", "8-Track", "Box Set", "Flexi", "Lathe Cut")
PRESSINGS = ("Album", "Single", "EP", "Maxi", "Comp", "RE", "RM", "Club", "Ltd", "Promo", "RSD", "Unofficial", "Bootleg")
MIXES = ("Mono", "Stereo", "Quad")
COLORS = {
    "Whi": "White Vinyl", "Blu": "Blue Vinyl", "Red": "Red Vinyl", "Gre": "Green Vinyl", "Yel": "Yellow Vinyl", "Ora": "Orange Vinyl",
    "Pur": "Purple Vinyl", "Pin": "Pink Vinyl", "Cle": "Clear Vinyl", "Gol": "Gold Vinyl", "Sil": "Silver Vinyl", "Bla": "Black Vinyl",
    "Fla": "Flame Vinyl", "Mar": "Marbled Vinyl", "Spl": "Splatter Vinyl", "Pic": "Picture Disc", "Mon": "Mono",
}
WEIGHTS = ("180", "200", "140", "150", "160", "220")
# Titles that name the same film, and director entries that name nobody.
TITLE_ALIASES = {"one hundred and one dalmatians": "101 dalmatians"}
NO_DIRECTOR = ("full credits", "nan", "", "n/a", "unknown")
# Colour names, and names of colour pairs and triples, by sorted colour codes.
COLOR_NAMES = {"W": "White", "U": "Blue", "B": "Black", "R": "Red", "G": "Green"}
IDENTITY_NAMES = {
    "U,W": "Azorius", "B,U": "Dimir", "B,R": "Rakdos", "G,R": "Gruul", "G,W": "Selesnya", "B,W": "Orzhov", "R,U": "Izzet", "B,G": "Golgari",
    "R,W": "Boros", "G,U": "Simic", "G,R,W": "Naya", "B,G,U": "Sultai", "B,R,U": "Grixis", "B,R,W": "Mardu", "G,U,W": "Bant",
}


def text(df: DataFrame, name: str) -> Column:
    """A column as trimmed text, null where blank, "nan" or missing."""
    if name not in df.columns:
        return F.lit(None).cast("string")
    return S.fact_value(F.col(f"`{name}`"), df.schema[name].dataType)


def _made(df: DataFrame, entity: Column, lens_id: str, facts: list[Column], nucleus: Column, label: Column, sublabel: Column) -> tuple[Column, DataFrame, DataFrame]:
    hub = df.select(entity.alias("entity_id"), nucleus.alias("nucleus"), F.coalesce(label, nucleus).alias("label"), F.coalesce(sublabel, F.lit("")).alias("sublabel"))
    return entity, spoke(df, entity, lens_id, facts), hub.where("entity_id is not null")


def records(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """A record collection: release_id, Artist, Title, Label, Catalog#, Format, Released, Date Added and two conditions."""
    release, artist, title = text(df, "release_id"), S.without_number_suffix(text(df, "Artist")), text(df, "Title")
    released = S.year(text(df, "Released"))
    parts = S.items(text(df, "Format"))
    among = lambda words: F.filter(parts, lambda p: p.isin(*words))
    facts = [
        fact("who", "artist", artist), facts_from_array("who", "label", S.items(text(df, "Label"))),
        fact("what", "title", title), fact("what", "catalog_no", S.first_item(text(df, "Catalog#"))),
        facts_from_array("what", "format", among(FORMATS)), facts_from_array("what", "pressing_type", among(PRESSINGS)), facts_from_array("what", "mix", among(MIXES)),
        facts_from_array("what", "color", F.transform(among(tuple(COLORS)), lambda p: S.lookup(COLORS)[p])), facts_from_array("what", "weight", F.transform(among(WEIGHTS), lambda p: F.concat(p, F.lit("g")))),
        fact("when", "released", released), fact("when", "year_added", S.year(text(df, "Date Added"))),
        fact("how", "media_condition", text(df, "Collection Media Condition")), fact("how", "sleeve_condition", text(df, "Collection Sleeve Condition")),
    ]
    return _made(df, F.concat(F.lit("discogs:"), release), lens_id, facts, release, title, S.sublabel(artist, released))


def _film(df: DataFrame, name: str) -> tuple[Column, Column]:
    title = text(df, name)
    return F.concat(F.lit("disney:"), S.slug(title, TITLE_ALIASES)), title


def film_characters(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """movie_title, release_date, hero, villian (so spelt in the source), song."""
    entity, title = _film(df, "movie_title")
    released = S.year(text(df, "release_date"))
    facts = [fact("who", "hero", text(df, "hero")), fact("who", "villain", text(df, "villian")), fact("what", "song", text(df, "song")), fact("what", "title", title), fact("when", "released", released)]
    return _made(df, entity, lens_id, facts, title, title, released)


def film_directors(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """name, director."""
    entity, title = _film(df, "name")
    director = text(df, "director")
    director = F.when(~F.lower(director).isin(*NO_DIRECTOR), director)
    return _made(df, entity, lens_id, [fact("who", "director", director), fact("what", "title", title)], title, title, director)


def film_voices(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """character, voice-actor, movie."""
    entity, title = _film(df, "movie")
    facts = [fact("who", "voice_actor", text(df, "voice-actor")), fact("who", "character", text(df, "character")), fact("what", "title", title)]
    return _made(df, entity, lens_id, facts, title, title, F.lit(""))


def film_gross(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """movie_title, release_date, genre, MPAA_rating, total_gross, inflation_adjusted_gross."""
    entity, title = _film(df, "movie_title")
    released = S.year(text(df, "release_date"))
    facts = [
        fact("what", "title", title), fact("what", "genre", text(df, "genre")), fact("what", "mpaa_rating", text(df, "MPAA_rating")),
        fact("what", "total_gross", S.money(text(df, "total_gross"))), fact("what", "inflation_adjusted_gross", S.money(text(df, "inflation_adjusted_gross"))), fact("when", "released", released),
    ]
    return _made(df, entity, lens_id, facts, title, title, released)


def sessions(df: DataFrame, lens_id: str) -> tuple[Column, DataFrame, DataFrame]:
    """Music sessions: eventid, artist, title, host, release_year, date, day_of_week, self-titled."""
    event = text(df, "eventid")
    event = F.when(event != "eventid", event)
    artist, title, year = text(df, "artist"), text(df, "title"), text(df, "release_year")
    facts = [
        fact("who", "artist", artist), fact("who", "host", text(df, "host")), fact("what", "title", title),
        fact("what", "self_titled", F.when(text(df, "self-titled") == "1", "true")),
        fact("when", "release_year", year), fact("when", "session_year", S.third_part(text(df, "date"))), fact("when", "day_of_week", text(df, "day_of_week")),
    ]
    return _made(df, F.concat(F.lit("shibuya:"), event), lens_id, facts, event, title, S.sublabel(artist, year))


TRANSLATORS: dict[str, Translator] = {
    "discogs": records,
    "disney_characters": film_characters,
    "disney_director": film_directors,
    "disney_voice_actors": film_voices,
    "disney_total_gross": film_gross,
    "shibuya": sessions,
}

CARD_SCHEMA = (
    "id string, name string, rarity string, oracle_text string, type_line string, colors array<string>, color_identity array<string>, keywords array<string>, artist string, "
    "released_at string, cmc double, mana_cost string, power string, toughness string, loyalty string, `set` string, collector_number string, legalities map<string,string>"
)


def cards(df: DataFrame, lens_id: str, set_name: str) -> DataFrame:
    """Facts of trading cards (CARD_SCHEMA)."""
    types, subtypes = S.type_words(F.col("type_line"))
    names = S.lookup(COLOR_NAMES)
    colors = F.coalesce("colors", F.array().cast("array<string>"))
    identity = S.lookup(IDENTITY_NAMES)[F.array_join(F.array_sort("color_identity"), ",")]
    legal = F.map_keys(F.map_filter(F.coalesce("legalities", F.create_map().cast("map<string,string>")), lambda _, v: v != "not_legal"))
    single = [("what", "name", "name"), ("what", "title", "name"), ("what", "rarity", "rarity"), ("what", "oracle_text", "oracle_text"), ("who", "artist", "artist"), ("how", "mana_cost", "mana_cost"), ("how", "power", "power"), ("how", "toughness", "toughness"), ("how", "loyalty", "loyalty"), ("where", "collector_number", "collector_number")]
    facts = [fact(d, k, F.col(c)) for d, k, c in single] + [
        fact("what", "set", F.lit(set_name)), fact("what", "guild", identity), fact("when", "released_at", F.substring("released_at", 1, 4)),
        fact("how", "cmc", F.col("cmc").cast("int").cast("string")), fact("where", "set_code", F.upper("set")),
        facts_from_array("what", "card_type", types), facts_from_array("what", "subtype", subtypes),
        facts_from_array("what", "color", F.transform(colors, lambda c: F.coalesce(names[c], c))), facts_from_array("what", "color_code", colors),
        facts_from_array("what", "keyword", F.col("keywords")), facts_from_array("why", "format_legal", legal),
    ]
    return spoke(df, F.concat(F.lit("scryfall:"), F.col("id")), lens_id, facts, dedup=False)
