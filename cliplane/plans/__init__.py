"""The query catalogue; the guard, media and tracking queries add themselves to it."""

from cliplane.plans import catalog, driving_catalog, guard_catalog, media_catalog, picture_catalog, pose_catalog, repair_catalog, sound_catalog, track_catalog

__all__ = ["catalog", "driving_catalog", "guard_catalog", "media_catalog", "picture_catalog", "pose_catalog", "repair_catalog", "sound_catalog", "track_catalog"]
