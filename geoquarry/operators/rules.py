"""Fixed values of query routing: rules in order, exemplars, stop words, floors."""

RULE_STRENGTH = 1.0
EXEMPLAR_FLOOR = 0.22
TASKS = ["caption", "vqa", "grounding", "change", "fusion"]
SINGLE_IMAGE = ["vqa", "caption", "grounding"]

#: (task, name, pattern); the first match decides, case is ignored.
RULES = [
    ("fusion", "fusion_sar_optical", r"\bsar\b.{0,80}\boptic(al|al|)\b"),
    ("fusion", "fusion_optical_sar", r"\boptic(al|al|)\b.{0,80}\bsar\b"),
    ("fusion", "fusion_cross_modal", r"\b(cross[ -]?modal|multi[ -]?sensor|multi[ -]?modal)\b"),
    ("fusion", "fusion_fuse", r"\bfus(e|es|ed|ing|ion)\b"),
    ("fusion", "fusion_joint", r"\bjoint(ly)?\s+(use|analysis|interpret\w*|reading)\b"),
    ("fusion", "fusion_complementary", r"\bcomplementar\w+\b"),
    ("fusion", "fusion_microwave_optical", r"\b(?:microwave|radar)\b.{0,80}\b(?:optical|visible|multispectral|msi|panchromatic)\b"),
    ("fusion", "fusion_optical_microwave", r"\b(?:optical|visible|multispectral|msi|panchromatic)\b.{0,80}\b(?:microwave|radar)\b"),
    ("fusion", "fusion_cross_reference", r"\bcross[- ]?referenc\w+\b"),
    ("fusion", "fusion_together", r"\b(?:use|used|using)\b.{0,60}\btogether\b.{0,60}\b(?:sar|radar)\b"),
    ("change", "change_what_changed", r"\bwhat\s+changed\b"),
    ("change", "change_has_changed", r"\bhas\s+\w+\s+(changed|increased|decreased|grown|shrunk|expanded|receded|regressed)\b"),
    ("change", "change_increased_decreased_unchanged", r"\bincreased,\s*(?:decreased|declined),\s*or\s+remain(?:ed|s)?\s+unchanged\b"),
    ("change", "change_compare_temporal", r"\bcompare[d]?\b.{0,40}\b(?:earlier|later|date|dates|before|after|ago)\b"),
    ("change", "change_changed_between", r"\bchang(?:ed|es|ing)\s+(?:between|over|across|since|from)\b"),
    ("change", "change_changed_between", r"\b(?:chang(?:ed|es|ing)|shift\w*|evolv\w*|alter(?:ed|es|ing)?|mov(?:ed|es|ing)?|fluctuat\w*|grow\w*|var(?:ied|ies|ying)?)\s+(?:between|over|across|since|from)\b"),
    ("change", "change_comparative_scale", r"\b(?:larger|smaller|bigger|greater|higher|lower|wider|narrower|more|less)\s+or\b"),
    ("change", "change_difference_between", r"\bdifferenc(?:e|es)\s+(?:between|among)\b"),
    ("change", "change_different_between", r"\bdifferent\s+between\b"),
    ("change", "change_before_after", r"\bbefore\s+and\s+after\b"),
    ("change", "change_over_time", r"\bover\s+time\b"),
    ("change", "change_trend_verb", r"\b(shrank|shrunk|shrink|expanded|expanding|declined|receded|retreated|dwindled)\b"),
    ("change", "change_grew_temporal", r"\b(?:grew|grown)\b.{0,40}\b(?:since|between|compared|than\s+before|over\s+the|in\s+the\s+last)\b"),
    ("change", "change_since_earlier", r"\bsince\s+(?:the\s+)?(?:earlier|previous|prior|first|last|original)\b"),
    ("change", "change_between_two_obs", r"\bbetween\s+the\s+two\s+(?:acquisitions?|dates?|images?|scenes?|photos?|passes?|observations?)\b"),
    ("change", "change_versus_before", r"\b(?:versus|vs\.?|compared\s+(?:to|with))\s+(?:before|earlier|previously|the\s+past)\b"),
    ("change", "change_different_temporal", r"\bdifferent\b.{0,30}\b(?:now|before|earlier|previously)\b"),
    ("change", "change_two_dates", r"\btwo\s+dates\b"),
    ("change", "change_bitemporal", r"\b[bB]i[\s-]?temporal\b"),
    ("change", "change_between_years", r"\bbetween\s+(?:19|20)\d{2}\b"),
    ("change", "change_from_year_to", r"\bfrom\s+(?:19|20)\d{2}\s*(?:to|-)\s*(?:19|20)\d{2}\b"),
    ("change", "change_new_construction", r"\bnew\s+(?:buildings?|construction|development|road|roads|colonies?)\b"),
    ("change", "change_landuse_shift", r"\b(?:deforestation|urbaniz\w+|urbanis\w+|reforest\w+|encroach\w+|accretion)\b"),
    ("change", "change_appeared_disappeared", r"\b(?:appeared|disappeared|vanished|emerged)\b"),
    ("change", "change_compare_images_default", r"\bcompar\w+\b.{0,40}\b(?:image|images|scene|scenes|pair|two)\b"),
    ("change", "change_detect_changes", r"\b(?:detect|detecting)\s+(?:the\s+)?changes?\b"),
    ("grounding", "grounding_highlight", r"\bhighlight\b"),
    ("grounding", "grounding_locate", r"\blocate\b"),
    ("grounding", "grounding_localize", r"\blocali[sz]\w*\b"),
    ("grounding", "grounding_where", r"\bwhere(?:\s+(?:is|are|was|were|did|do|does|have|has)|'s|'re)\b"),
    ("grounding", "grounding_find_object", r"\bfind\s+(?:the|any|all|every|these|those)\b"),
    ("grounding", "grounding_identify_object", r"\bidentif\w+\s+(?:the|any|all|these|those)\s+\w+\s+(?:buildings|structures|roads|fields|crops|zones|areas|regions|parcels|lots)\b"),
    ("grounding", "grounding_bbox", r"\bbounding\s*boxes?\b"),
    ("grounding", "grounding_mark", r"\bmark\s+(?:the|all|out|every)\b"),
    ("grounding", "grounding_point", r"\bpoint\s+(?:to|out)\b"),
    ("grounding", "grounding_show_where", r"\bshow\s+me\s+where\b"),
    ("grounding", "grounding_segment", r"\bsegment(?:ation)?\b"),
    ("grounding", "grounding_delineate", r"\bdelineat\w*\b"),
    ("grounding", "grounding_location_of", r"\b(?:the\s+)?location\s+of\b"),
    ("grounding", "grounding_referring", r"\breferred\s+to\s+in\s+the\s+query\b"),
    ("caption", "caption_describe", r"\bdescrib\w*\b"),
    ("caption", "caption_description", r"\bdescription\b"),
    ("caption", "caption_caption", r"\bcaption(?:ing)?\b"),
    ("caption", "caption_overview", r"\boverview\s+of\b"),
    ("caption", "caption_what_shown", r"\bwhat(?:'s|\s+is)?\s+(?:shown|in|on|pictured)\b"),
    ("caption", "caption_what_show", r"\bwhat\s+(?:does|do)\s+(?:this|the)\s+(?:image|scene|photo)s?\s+(?:show|contain)\b"),
    ("caption", "caption_summarize", r"\bsummariz\w+\b"),
    ("caption", "caption_summary", r"\bsummary\s+of\b"),
    ("caption", "caption_tell_me_about", r"\btell\s+me\s+about\b"),
    ("caption", "caption_narrate_depict", r"\b(?:narrat\w+|depict\w+|portray\w+|illustrat\w+)\b"),
    ("caption", "caption_what_can_see", r"\bwhat\s+can\s+(?:you\s+)?(?:see|observe)\b"),
    ("caption", "caption_dominant_scene", r"\bscene\s+content\b"),
    ("vqa", "vqa_rural_urban", r"\brural\b.*\burban\b|\burban\b.*\brural\b"),
    ("vqa", "vqa_how_many", r"\bhow\s+many\b"),
    ("vqa", "vqa_are_there", r"\bare\s+there\b"),
    ("vqa", "vqa_is_there", r"\bis\s+there\b"),
    ("vqa", "vqa_object_state", r"\bis\s+(?:the|this)\b.{0,50}\b(?:full|empty|deep|shallow|dry|damp|clear)\b"),
    ("vqa", "vqa_which", r"\bwhich\b"),
    ("vqa", "vqa_what_fraction", r"\bwhat\s+(?:fraction|percentage|percent|proportion|share|portion|amount|area|extent|fraction)\s+of\b"),
    ("vqa", "vqa_yesno_show", r"\bdoes\s+this\s+(?:image|scene|picture|photo|imagery)\s+(?:show|contain|depict|display|have)\b"),
    ("vqa", "vqa_how_much", r"\bhow\s+(?:much|big|large|wide|far|deep|large|common|large|health)\b"),
    ("vqa", "vqa_dominant", r"\b(?:dominant|predominat\w+|prevail\w*)\b"),
    ("vqa", "vqa_classify", r"\bclassif\w*\b"),
    ("vqa", "vqa_count", r"\bcount\s+(?:the|of|all|any)\b"),
    ("vqa", "vqa_average_mean", r"\baverage\b|\bmean\b"),
    ("vqa", "vqa_what_is", r"\bwhat\s+(?:is|are|'s|kind|type|class)\b"),
    ("vqa", "vqa_land_cover", r"\bl(?:and)?[- ]?cover\b"),
    ("vqa", "vqa_water_level", r"\b(?:water\s+level|area\s+of\s+water|extent\s+of\s+water)\b"),
    ("vqa", "vqa_yields", r"\b(?:yield|harvest)\b"),
]

#: Example queries per task.
EXEMPLARS = {
    "caption": [
        "describe the land-cover and major objects visible in this image",
        "describe the scene you see",
        "what is shown in this image",
        "caption this satellite image",
        "provide an overview of what the image shows",
        "summarize what you can see in this image",
        "what does this image contain",
        "describe the dominant land cover in the scene",
        "give a general description of the scene",
        "what's going on in this picture",
    ],
    "vqa": [
        "how many buildings are there in this image",
        "are there any water bodies visible",
        "what is the dominant land cover type",
        "which crop is being grown here",
        "is there a river in this image",
        "what fraction of the image is urban area",
        "how large is the forested area",
        "what kind of land cover is present",
        "count the number of vehicles in the parking lot",
    ],
    "grounding": [
        "highlight the water body in this image",
        "locate the buildings in the scene",
        "where is the river",
        "find the urban area",
        "bounding box around the crop fields",
        "point to the airport in the image",
        "mark the roads for me",
        "show me where the forest is",
        "where exactly is the reservoir",
    ],
    "change": [
        "what changed between these two dates",
        "compare these two images",
        "has the built-up area increased, decreased, or remained unchanged",
        "detect changes between the two images",
        "what are the differences between these two scenes",
        "identify new developments over time",
        "how has the coastline changed in this period",
        "analyze the change between the before and after images",
    ],
    "fusion": [
        "use the optical and SAR images together to identify built-up and water-covered regions",
        "combine the optical and SAR data",
        "cross-modal analysis of the SAR and optical scenes",
        "jointly interpret the sar and optical images",
        "fuse the optical and sar channels",
        "use both the sar and optical images to find water",
        "merge sar and optical information to identify flooded areas",
    ],
}

STOP_WORDS = """
    a an the and or nor but for with of at on in into from by to this that
    these those it its is are was were be been being am do does did can could
    will would shall should may might must have has had having not no yes
    what which who whom whose how where when why whether there here both each
    any all some every about between during under over above before after
    image images scene scenes photo photos picture pictures date dates pair
    them they their your you your me my i we us our
""".split()

#: Which image a query names, tested in this order.
REFERENCES = [
    ("second", r"\b(?:second|2nd|latter|other\s+image|image\s+2|2nd\s+image|last\s+image)\b"),
    ("first", r"\b(?:first|1st|image\s+1|1st\s+image)\b"),
    ("both", r"\b(?:both|each)\s+image\b|\bboth\b"),
]

#: Parts dropped from a locating query, in order.
TARGET_LEAD = (
    r"^\s*(?:highlight|locate|localize|find|mark|point out|point to|show me|segment|delineate|identify|detect|"
    r"bound the|bounding box(?:es)? (?:of|for|around|on)|box(?:es)? (?:around|for|of)|"
    r"draw (?:a|an|the|me)? ?(?:bounding )?box(?:es)? (?:around|for|on)?|where (?:is|are|was|were)|"
    r"where exactly is|the location of|location of)"
)
TARGET_WHERE = r"^\s*where\s*(?:'s|'re| is| are| was| were| did| do| does| have| has)?\s+(?:the|a|an)?\s+"
TARGET_TRAIL = (
    r"\s*(?:is|are|was|were|it\b|referred to in the (?:query|text|sentence|image)|"
    r"in (?:this|the|that) (?:satellite )?(?:image|scene|photo|picture)|in the image|in the scene|in the query|"
    r"that you can see|you can see)[.\s]*$"
)
TARGET_ARTICLE = r"^\s*(?:the|a|an)\s+"
TARGET_EDGE = r"^[ .?!\t\n]+|[ .?!\t\n]+$"
WHOLE_EDGE = r"^[ .?!]+|[ .?!]+$"
