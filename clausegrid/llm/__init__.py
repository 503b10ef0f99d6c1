"""Operations of a training-data pipeline: fingerprints, archives, licences, search, mixing, extraction, packing,
quality, sharding and near-duplicates. Nothing outside this folder imports it."""
