"""Schemas of the exchanged records; ids are texts, as leading zeros matter."""

_VALUE = "struct<value: string>"
NUTRITION = f"struct<calories: {_VALUE}, fat: {_VALUE}, protein: {_VALUE}, carbohydrates: {_VALUE}>"
PRODUCT = f"id string, supermarket string, description string, denomination string, brand string, category string, price double, unit_price string, raw_ingredients string, nutrition_information {NUTRITION}"
LEGACY_PRODUCT = "productIdInSupermarket string, denomination string, brand string, price double, measuringUnit struct<value: string, format: string, unit: string>"
PROCESSED = f"{PRODUCT}, product_concatenation string, product_embedding array<float>"
CATEGORY_MAP = "source_supermarket string, target_supermarket string, mapping_results array<struct<source_category: string, matched_target_category: string, similarity_score: double>>"
WHITE_LABELS = "general array<string>"
TRUTH = "`ER Referencia eroski` string, `Ref competidor` string, Eroski_Denomination string, Makro_Denomination string"
CATEGORY_TRUTH = "source_category string, target_category string"
SIMILAR = "id string, productIdInSupermarket string, description string, denomination string, brand string, price double, unit_price string, distance double, product_concatenation string, main_words array<string>"
REPORT = f"id string, description string, brand string, price double, unit_price string, product_concatenation string, main_words array<string>, similar_products array<struct<{SIMILAR.replace(' string', ': string').replace(' double', ': double').replace(' array<', ': array<')}>>"
