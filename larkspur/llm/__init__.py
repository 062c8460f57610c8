"""Training-data operators (quality, packing, chat, LM, decontamination, media,
URL, license, language and near-duplicate operators).  Nothing else in the
library imports this subpackage."""
